"""Language identification by Bayesian fusion of independent kinds of evidence.

* Text: log-likelihoods of hashed byte trigrams under a model of each language, and under a uniform
  one for no language at all ("und").  The mean over the whole text counts as ``weight`` trigrams at
  most, since neighbouring trigrams are not independent.
* Declared language (a table's own column, or a page's html lang attribute) and address suffix: how
  often each value goes with each language, from all rows, smoothed.
* Host: the languages of its rows, smoothed towards those of its domain, these towards those of all
  rows; a row's own part is left out of its prior.  A name without a dot has no domain.

The ``most`` languages that most rows declare have a model each; all others share one model of what
they have in common against these, and a row that it wins is named by its own declared language, or
"mis" where it declares none of them.  So tables have a fixed size however many tags there are, and no
row goes because its language is rare.

The trigram models are fitted on a sample of about ``train_rows`` rows of each declared language (and
of the shared one), by a hash of their key; they are tables of fixed size and are broadcast.  Everything
else is counted over all rows by grouped aggregation and joined back on its key, so a host of any size is
pre-aggregated and its rows are only a skewed join's side; rows without a host are dealt out.  Texts are
read once for the models and once for the scores, whole; scores, not texts, are shuffled.

A row is accepted if its best language is not "und" and has at least ``least`` of the posterior.

Nulls: a null text is an empty one, which has no text evidence, counts for no language and is not
accepted; null declared language, suffix or host is no evidence of that kind.  Repeated rows are scored
alike.  Where no row declares a language, no language is known and nothing is accepted.  An empty table
gives an empty result.  Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestext import LOWER, as_bytes, slices
from .scratch import stage

GRAMS = 1 << 15
#: No language; one of the languages that share a model, where the row does not say which.
UNKNOWN, RARE = "und", "mis"
#: Languages with a model of their own, by rows that declare them; bytes of a table that is broadcast.
LANGUAGES, SMALL = 64, 32 << 20


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased bytes, and the row of each; digits and ASCII signs count as blanks."""
    body, offsets = as_bytes(texts)
    letters = LOWER[body]
    letters = np.where((letters >= 97) & (letters <= 122) | (letters >= 128), letters, 32).astype(np.uint32)
    if len(letters) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    joined = letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    held = (row[:-2] == row[2:]) & (joined != 0x202020)
    hashed = (joined[held].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    return hashed.astype(np.int64), row[:-2][held]


def _counts(languages: list[str]):
    """Trigram counts of each language in a task's rows; what is not listed counts for the last."""
    at = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), GRAMS), np.int64)
        for batch in batches:
            for part in slices(batch):
                gram, row = grams(part.column(1))
                which = np.array([at.get(x, len(at) - 1) for x in part.column(0).to_pylist()], np.int64)
                total += np.bincount(which[row] * GRAMS + gram, minlength=total.size).reshape(total.shape)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen // GRAMS), pa.array(seen % GRAMS), pa.array(total.ravel()[seen])], ["language", "gram", "n"])

    return run


def fit(rows: DataFrame, train_rows: int, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language): those of their own, RARE if there are more, and UNKNOWN, which is uniform."""
    known = rows.where("declared IS NOT NULL").groupBy("declared").count()
    known = stage(known, "language-tags").df
    top = known.orderBy(F.col("count").desc(), "declared").limit(most).collect()
    languages = sorted(r["declared"] for r in top)
    if not languages:
        return [UNKNOWN], np.full((1, GRAMS), -np.log(GRAMS))
    rest = (known.agg(F.sum("count")).first()[0] or 0) - sum(r["count"] for r in top)
    sizes = {r["declared"]: r["count"] for r in top}
    if rest:
        languages.append(RARE)
    share = F.coalesce(F.get(F.lit([min(1.0, train_rows / sizes[x]) for x in languages if x in sizes]), F.array_position(F.lit([x for x in languages if x in sizes]), F.col("declared")).cast("int") - 1), F.lit(min(1.0, train_rows / max(rest, 1))))
    part = rows.where("declared IS NOT NULL").where(F.pmod(F.xxhash64(F.lit("fit"), "key"), F.lit(1 << 20)) < share * (1 << 20))
    found = part.select("declared", "text").mapInArrow(_counts(languages), "language long, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages), GRAMS))
    total[found["language"].to_numpy(), found["gram"].to_numpy()] = found["n"].to_numpy()
    log = np.log((total + 0.5) / (total + 0.5).sum(axis=1, keepdims=True))
    return [*languages, UNKNOWN], np.concatenate([log, np.full((1, GRAMS), -np.log(GRAMS))])


def _text_scores(held, weight: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = held.value
        for batch in batches:
            for part in slices(batch, 0):
                gram, row = grams(part.column(0))
                n = np.bincount(row, minlength=part.num_rows)
                scores = np.stack([np.bincount(row, weights=table[gram], minlength=part.num_rows) for table in log], axis=1).astype(float)
                scores *= (np.minimum(n, weight) / np.maximum(n, 1))[:, None]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), len(log)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n), lists], [*columns, "n_grams", "scores"])

    return run


def _posterior(scores: Column) -> Column:
    """Probabilities from an array of log scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(
    docs: DataFrame, key: str, text: str, declared: str | None = None, host: str | None = None, train_rows: int = 4000, weight: int = 200, prior: float = 5.0, least: float = 0.5, most: int = LANGUAGES
) -> DataFrame:
    """The key, language, confidence, accepted and text_language of each row.

    ``host`` holds host names or whole addresses; the domain is its last two labels, the suffix its last.
    """
    none = F.lit(None).cast("string")
    kind = docs.schema[key].dataType.simpleString()
    name = F.lower(F.regexp_extract(F.col(host), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1)) if host else none
    rows = docs.select(
        F.col(text).alias("text"), F.col(key).alias("key"), (F.lower(F.col(declared)) if declared else none).alias("declared"), F.nullif(name, F.lit("")).alias("host")
    )
    rows = rows.withColumn("declared", F.nullif(F.regexp_extract("declared", r"^\s*([a-z]+)", 1), F.lit("")))
    languages, log = fit(rows, train_rows, most)
    held = docs.sparkSession.sparkContext.broadcast(log.astype(np.float32))
    columns = ["key", "declared", "host"]
    scored = rows.mapInArrow(_text_scores(held, weight, columns), f"key {kind}, declared string, host string, n_grams bigint, scores array<double>")
    dotted = F.contains(F.col("host"), F.lit("."))
    scored = scored.withColumn("domain", F.when(dotted, F.substring_index("host", ".", -2))).withColumn("suffix", F.when(dotted, F.substring_index("host", ".", -1)))
    best = F.when(F.col("n_grams") > 0, _argmax(F.col("scores")))
    return fuse(stage(scored.withColumn("best", best), "language-scores").df, languages, prior, least).withColumnRenamed("key", key)


def fuse(scored: DataFrame, languages: list[str], prior: float = 5.0, least: float = 0.5) -> DataFrame:
    """The decision from scored(key, declared, host, domain, suffix, n_grams, scores, best): text scores and all other evidence.

    ``scores`` are log-likelihoods by position in languages; best is the position of the greatest, null without trigrams.
    """
    m = len(languages)
    one_hot = F.array(*[F.coalesce((F.col("best") == i).cast("double"), F.lit(0.0)) for i in range(m)])

    def counted(by: list[str]) -> DataFrame:
        sums = [F.coalesce(F.sum((F.col("best") == i).cast("double")), F.lit(0.0)).alias(f"_{i}") for i in range(m)]
        return scored.groupBy(*by).agg(*sums).select(*by, F.array(*[f"_{i}" for i in range(m)]).alias("c"))

    total = scored.agg(*[F.sum((F.col("best") == i).cast("double")).alias(f"_{i}") for i in range(m)]).first()
    overall = [float(x or 0.0) for x in total]
    whole = sum(overall)
    base = F.lit([(x + 1) / (whole + m) for x in overall])
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    zero = F.array_repeat(F.lit(0.0), F.lit(m))

    def evidence(column: str) -> DataFrame:
        """log P(value | language) for each value of a column, over all rows."""
        n = counted([column]).where(f"{column} IS NOT NULL")
        return n.select(F.col(column).alias(f"of_{column}"), F.zip_with("c", F.lit(overall), lambda c, t: F.log((c + 0.5) / (t + 0.5 * (m + 1)))).alias(f"{column}_log"))

    def beside(rows: DataFrame, told: DataFrame, column: str) -> DataFrame:
        """rows with what is told of a column's values.

        A table of few values is broadcast, so that the rows of a hot one stay where they are.  Else rows are dealt
        by value, those without one being dealt out, as they meet nothing.
        """
        told = stage(told, f"language-{column}").df
        if told.count() * 8 * (m + 4) <= SMALL:
            return rows.join(F.broadcast(told), F.col(column) == F.col(f"of_{column}"), "left")
        dealt = F.coalesce(F.col(column), F.concat(F.lit("\0"), F.pmod(F.hash("key", "scores"), F.lit(4096)).cast("string")))
        return rows.join(told, dealt == F.col(f"of_{column}"), "left")

    domains = counted(["domain"]).where("domain IS NOT NULL").select(F.col("domain").alias("of_domain"), F.col("c").alias("domain_c"))
    hosts = counted(["host"]).where("host IS NOT NULL").select(F.col("host").alias("of_host"), F.col("c").alias("host_c"))
    joined = scored
    for told, column in ((hosts, "host"), (domains, "domain"), (evidence("declared"), "declared"), (evidence("suffix"), "suffix")):
        joined = beside(joined, told, column)

    def others(c: str) -> Column:
        return F.when(F.col(c).isNull(), zero).otherwise(F.zip_with(c, one_hot, lambda x, own: F.greatest(x - own, F.lit(0.0))))

    def smoothed(c: str, towards: Column) -> Column:
        return F.zip_with(F.col(c), towards, lambda x, p: x + prior * p)

    joined = joined.withColumn("dc", others("domain_c")).withColumn("hc", others("host_c"))
    joined = joined.withColumn("dp", smoothed("dc", base)).withColumn("dp", F.transform("dp", lambda x: x / (sum_of(F.col("dc")) + prior)))
    joined = joined.withColumn("hp", smoothed("hc", F.col("dp"))).withColumn("hp", F.transform("hp", lambda x: x / (sum_of(F.col("hc")) + prior)))
    fused = _added(F.transform("hp", lambda p: F.log(F.greatest(p, F.lit(1e-9)))), F.col("scores"))
    fused = _added(_added(fused, F.coalesce("declared_log", zero)), F.coalesce("suffix_log", zero))
    joined = joined.select("key", "declared", "n_grams", "best", fused.alias("fused")).withColumn("posterior", _posterior(F.col("fused")))
    names = F.lit(languages)
    rare = F.when(~F.col("declared").isin(languages), F.col("declared"))
    named = lambda at: F.when(F.get(names, at) == RARE, F.coalesce(rare, F.lit(RARE))).otherwise(F.get(names, at))
    out = joined.select(
        "key", named(_argmax(F.col("posterior"))).alias("language"), F.array_max("posterior").alias("confidence"), "n_grams",
        F.coalesce(named(F.col("best")), F.lit(UNKNOWN)).alias("text_language"),
    )
    ok = (F.col("language") != UNKNOWN) & (F.col("confidence") >= least) & (F.col("n_grams") > 0)
    return out.withColumn("accepted", ok).select("key", "language", "confidence", "accepted", "text_language")


def page_rows(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with their visible text and the language their markup declares."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    lang = F.regexp_extract(F.col(html), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select(F.col(key), F.col(url), F.regexp_replace(body, r"&[#A-Za-z0-9]+;", " ").alias("text"), F.nullif(lang, F.lit("")).alias("declared"))
