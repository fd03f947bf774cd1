"""The corpus operators as queries over the driver's tables: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, languages, licenses, middles, mixing, packing, passages, quality, sharding, simhash, topk, whitening

#: Where the public vocabulary files live; None asks the installed package.
TOKENIZERS: str | None = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards, counts at most one apart."""
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without 50-byte strings of earlier documents."""
    return passages.dedup_passages(_table(spark, sf_dir, "documents"))


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return fingerprints.edit_check(_table(spark, sf_dir, "documents"))


def op5_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and the component it is linked to."""
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, from text, declared language and source."""
    return languages.identify(_table(spark, sf_dir, "documents"), "doc_id", "text", declared="lang", host="source")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all pages, from text, markup, address suffix and host."""
    return languages.identify(languages.page_rows(_table(spark, sf_dir, "pages")), "page_id", "text", declared="declared", host="url")


def op8_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of each query vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_factorization_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document; labels of every fifth id by checksum are held out of the fit."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = quality.score(docs, labels.where(fold != 0))
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), capacity=2048)


def op11_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first eight components of their covariance, each to unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts that these decode to."""
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary())
    decoded = bpe.decode(encoded.withColumn("ids_sha256", F.sha2("ids", 256)), vocabulary())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rewritten with a middle of whole lines last, and rebuilt from that."""
    made = middles.fill_in_middle(_table(spark, sf_dir, "documents"))
    restored = F.sha2(middles.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored)


QUERIES = {
    "op1_consistent_ring": op1_consistent_ring,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_closed_syncmers": op4_closed_syncmers,
    "op5_cube_mix": op5_cube_mix,
    "op6_simhash_components": op6_simhash_components,
    "op7_language_fusion": op7_language_fusion,
    "page_languages": page_languages,
    "op8_ball_tree_topk": op8_ball_tree_topk,
    "op9_factorization_quality": op9_factorization_quality,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_chan_whitening": op11_chan_whitening,
    "op12_trie_bpe": op12_trie_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op8_ball_tree_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
            FROM v AS a JOIN v AS b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s
        ) WHERE rank <= 5
    """,
}
