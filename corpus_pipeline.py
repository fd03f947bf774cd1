"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the
last returns the packed pieces.  Between stages the rows are written as Parquet and read again, so a
stage starts from files that all executors share.

1. Language ID: rows whose text shows no known language go.
2. Near duplicates: texts whose five-word shingles are 0.8 alike (exact Jaccard; candidates by MinHash
   bands, as SimHash bits find few of them) are linked, and of each group one row stays, that of the smallest
   doc_id (nulls last; of rows that share it, the least by content).  Rows of one doc_id and unlike texts all stay.
3. Suffix-array dedup: passages that an earlier row has go, in whole characters; rows stay.
4. Mixing: each row is repeated as often as the mix takes it; rows taken no time go.
5. Packing: pieces of at most 2048 ids in sequences.

Rows with a null text have no language and go in stage 1, as do empty ones.  Empty tables give empty
results.  Other columns of documents, whatever their names and types, are carried along unread but for
the hash that tells rows apart: what a stage adds for itself has names that documents do not have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import languages, mixing, nearcopies, packing, passages
from ledgerloom.llm.columns import repeated
from ledgerloom.llm.queries import vocabulary
from ledgerloom.llm.scratch import only, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has, whatever the case of its letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while f"__{name}" in taken:
            name = f"{name}_"
        out.append(f"__{name}")
    return out


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _content(docs: DataFrame) -> Column:
    """128 bits of each row's content, as text; maps, which cannot be hashed, go in as JSON."""
    shown = [F.to_json(c) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else c for c, f in zip(_own(docs), docs.schema.fields)]
    return F.concat(F.hex(F.xxhash64(*shown)), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), *shown)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose best language is a known one."""
    (row,) = _free(docs, "row")
    rows = docs.withColumn(row, _content(docs))
    found = lambda: languages.identify(rows, row, "text", declared="lang", host="source").where("accepted").select(row).distinct()
    kept = only(spark, "language-kept", found)
    return rows.join(kept, row, "left_semi").select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id, null last, and of these the least by content."""
    (row,) = _free(docs, "row")
    rows = docs.withColumn(row, _content(docs))
    least = nearcopies.least_keys(rows, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")))
    kept = rows.join(least.select(F.col("key.row").alias(row)), row, "left_semi")
    return kept.dropDuplicates([row]).select(*_own(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that rows of smaller ids have."""
    mine, md5, first, size, kept = _free(docs, "mine", "md5", "first", "size", "kept")
    cut = passages.cut_passages(docs, keep_text=True).select("md5", "first", "n_bytes", "kept").toDF(md5, first, size, kept)
    rows = docs.withColumn(mine, F.unhex(F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")))).join(cut, F.col(mine) == F.col(md5))
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) > F.col(first)) & (F.col(size) >= passages.SIZE)
    rows = rows.withColumn("text", F.when(copy, F.lit("")).otherwise(F.coalesce(kept, "text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*_own(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; equal rows are one row that is taken as often as all of them."""
    row, taken, alike, copy, cut = _free(docs, "row", "taken", "alike", "copy", "cut")
    rows = docs.withColumn(row, _content(docs))
    mixed = only(spark, "mix-taken", lambda: mixing.mix_folded(rows, key=row).where("copies > 0").select(row, F.col("copies").alias(taken), F.col("rows").alias(alike)))
    most = mixed.agg(F.max(taken)).first()[0] or 0
    one = rows.join(mixed, row)
    once = one.where(F.col(alike) == 1).unionByName(one.where(F.col(alike) > 1).dropDuplicates([row]))
    return repeated(once, copy, F.lit(1).cast("long"), F.col(taken), most, cut).select(*_own(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, in sequences of at most 2048 ids."""
    return packing.pack(docs, vocabulary(), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: Neither fingerprints, models, the draw nor tokens can be had in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"corpus-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
