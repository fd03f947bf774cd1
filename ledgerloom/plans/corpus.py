"""Queries over documents, passages, labels, vectors and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from ..functions.chunks import chunked
from ..operators import contamination, evidence, repair, split
from ..operators.groups import written
from ..sources import sinks
from .registry import query, table
from .views import VERIFIED, verified

#: Rules over the words of the driver's documents.
FACTS = [
    ("Apache License", "Rule", "REQUIRES", "Notice", "Field", ["apache license"], 0.9, ["apache"]),
    ("MIT License", "Rule", "COVERS", "PermissiveUse", "Instrument", ["mit license"], 0.9, ["mit"]),
    ("GPL", "Rule", "CONFLICTS_WITH", "ClosedSource", "Instrument", ["general public license", "version"], 0.8, ["gnu"]),
    ("CC BY-NC", "Rule", "CONFLICTS_WITH", "CommercialUse", "Instrument", ["licensed", "cc"], 0.7, ["creative commons"]),
    ("Idiot", "Risk", "TRIGGERS", "ToxicText", "Risk", ["idiot"], 0.6, []),
    ("The", "Field", "RELATED_TO", "English", "Workflow", ["the", "and"], 0.5, ["en"]),
    ("Der", "Field", "RELATED_TO", "German", "Workflow", ["der", "die"], 0.5, ["de"]),
    ("Les", "Field", "RELATED_TO", "French", "Workflow", ["les", "et"], 0.5, ["fr"]),
    ("Los", "Field", "RELATED_TO", "Spanish", "Workflow", ["los", "el"], 0.5, ["es"]),
]
#: Rules that break the graph's: a relation and a type that there are not, a confidence beyond 1.
BROKEN = [
    ("And", "Field", "CAUSES", "English", "Workflow", ["and"], 0.5, []),
    ("Und", "Word", "RELATED_TO", "German", "Workflow", ["und"], 0.5, []),
    ("Est", "Field", "RELATED_TO", "French", "Workflow", ["est"], 1.5, []),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_HAS = "CASE WHEN regexp_full_match(t, '[a-z0-9.]+') THEN contains(padded, ' ' || t || ' ') OR contains(padded, ' ' || t || '.') ELSE contains(lt, t) END"


def _triples_sql(facts: list[tuple], docs: str = "SELECT doc_id, text FROM documents") -> str:
    values = ", ".join("(" + ", ".join([_quoted(x) for x in f[:5]] + ["[" + ", ".join(map(_quoted, f[5])) + "]", f"{f[6]}::DOUBLE"]) + ")" for f in facts)
    return (
        f"WITH facts(head, head_type, relation, tail, tail_type, triggers, confidence) AS (VALUES {values}), d AS ({docs}), l AS (SELECT *, replace(lower(text), 'mt ', 'mt') AS lt FROM d),"
        " q AS (SELECT *, ' ' || regexp_replace(lt, '[^a-z0-9.]', ' ', 'g') || ' ' AS padded FROM l),"
        f" triples AS (SELECT head, head_type, relation, tail, tail_type, confidence, doc_id AS source, text, triggers FROM q, facts WHERE len(list_filter(triggers, lambda t: NOT ({_HAS}))) = 0) "
    )


_TRIPLES = _triples_sql(FACTS)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.extract(table(spark, sf_dir, "documents").select("doc_id", "text"), evidence.facts_table(spark, FACTS), "doc_id", "text")


@query(_TRIPLES + "SELECT head, relation, tail, confidence, source FROM triples")
def keyword_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select("head", "relation", "tail", "confidence", "source")


@query(_TRIPLES + "SELECT head, relation, tail, max(confidence) AS confidence, min(source) AS source FROM triples GROUP BY ALL")
def triple_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merge_relations(triples(spark, sf_dir)).select("head", "relation", "tail", "confidence", "source")


@query(_TRIPLES + "SELECT relation, count(DISTINCT (head, tail)) AS edges, count(DISTINCT source) AS sources FROM triples GROUP BY relation")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).groupBy("relation").agg(F.count_distinct(F.struct("head", "tail")).alias("edges"), F.count_distinct("source").alias("sources"))


@query(
    _triples_sql(FACTS + BROKEN) + ", m AS (SELECT head, relation, tail, max(confidence) AS confidence FROM triples GROUP BY ALL), names AS (SELECT head AS name FROM triples WHERE head_type <> 'Field' UNION SELECT tail FROM triples WHERE tail_type <> 'Field')"
    f" SELECT head, relation, tail, 'relation' AS why FROM m WHERE relation NOT IN ({', '.join(map(_quoted, evidence.RELATION_TYPES))}) UNION ALL SELECT head, relation, tail, 'confidence' FROM m WHERE confidence > 1"
    " UNION ALL SELECT head, relation, tail, 'head' FROM m WHERE head NOT IN (SELECT name FROM names) UNION ALL SELECT head, relation, tail, 'tail' FROM m WHERE tail NOT IN (SELECT name FROM names)"
)
def dangling_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the graph of all rules, sound and broken, when no field is an entity."""
    rows = evidence.extract(table(spark, sf_dir, "documents").select("doc_id", "text"), evidence.facts_table(spark, FACTS + BROKEN), "doc_id", "text")
    return evidence.broken(evidence.entities(rows).where("type <> 'Field'"), evidence.merge_relations(rows))


@query(_triples_sql(FACTS + BROKEN) + "SELECT head AS name, head_type AS type, 'type' AS why FROM triples WHERE head_type = 'Word' GROUP BY ALL")
def unknown_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.extract(table(spark, sf_dir, "documents").select("doc_id", "text"), evidence.facts_table(spark, FACTS + BROKEN), "doc_id", "text")
    return evidence.broken_entities(evidence.entities(rows))


@query(_TRIPLES + "SELECT head, relation, tail, source, max(confidence) AS confidence FROM triples GROUP BY ALL")
def corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the corpus, one for each source that tells them."""
    return evidence.merge_corpus(triples(spark, sf_dir)).select("head", "relation", "tail", "source", "confidence")


@query(_TRIPLES + "SELECT name, type, max(source) AS source FROM (SELECT head AS name, head_type AS type, source FROM triples UNION ALL SELECT tail, tail_type, source FROM triples) GROUP BY ALL")
def corpus_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the corpus, as the last source has them."""
    return evidence.entities(triples(spark, sf_dir), last=True)


@query(_TRIPLES + "SELECT head || ' ' || relation || ' ' || tail AS triple, min(source) AS source, round(max(confidence), 4) AS confidence, true AS told FROM triples GROUP BY head, relation, tail")
def triple_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verdict shows of each triple of the corpus, and whether it has a sentence to show that the source holds."""
    rows = evidence.merge_relations(triples(spark, sf_dir))
    entries = rows.select(evidence.evidence_entry(F.struct(*rows.columns)).alias("e")).select("e.*")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("whole"))
    return entries.join(texts, "source").select("triple", "source", "confidence", (F.contains("whole", F.col("text")) & (F.length("text") > 0)).alias("told"))


@query(_TRIPLES + ", n AS (SELECT count(*) AS n FROM (SELECT DISTINCT head, relation, tail FROM triples)) SELECT load, n FROM n, (VALUES (1), (2)) AS l(load)")
def graph_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph table after the triples were loaded once, and after they were loaded again."""
    new, _ = written(triples(spark, sf_dir).select("head", "relation", "tail", "confidence", "source"), "graph-new")
    first, _ = written(sinks.merge_graph(None, new, ["head", "relation", "tail"], "confidence"), "graph-1")
    second, _ = written(sinks.merge_graph(first, new, ["head", "relation", "tail"], "confidence"), "graph-2")
    counted = lambda rows, load: rows.agg(F.lit(load).alias("load"), F.count(F.lit(1)).alias("n"))
    return counted(first, 1).unionByName(counted(second, 2))


@query("SELECT doc_id, sha256(text) AS signature FROM documents")
def doc_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("signature"))


@query("SELECT sha256(text) AS signature, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("signature"))
    return rows.groupBy("signature").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage word for word."""
    found = contamination.containments(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("item").alias("item_id"), F.col("key").alias("doc_id"))


_CLASSES = (
    "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),"
    " s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS s FROM w),"
    " m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM s), c AS (SELECT class_id AS c, unnest(s) AS g, len(s) AS n FROM m WHERE doc_id = class_id),"
    " p AS (SELECT x.c AS a, y.c AS b, count(*)::DOUBLE / (max(x.n) + max(y.n) - count(*)) AS j FROM c x JOIN c y ON x.g = y.g AND x.c < y.c GROUP BY ALL) "
)


def near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.near_groups(rows, "doc_id", T.word_shingles(F.col("text")))


@query(
    _CLASSES.replace("WITH w", "WITH RECURSIVE w") + ", e AS (SELECT a, b FROM p WHERE j >= 0.8 UNION ALL SELECT b, a FROM p WHERE j >= 0.8), r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)"
    " SELECT doc_id, class_id, least(class_id, coalesce((SELECT min(y) FROM r WHERE x = class_id), class_id)) AS group_id FROM m"
)
def near_dup_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the group of each document: a class has equal sets of five-word shingles, a group all that links of 0.8 or more reach."""
    return near_classes(spark, sf_dir).select(F.col("key").alias("doc_id"), F.col("class").alias("class_id"), F.col("group").alias("group_id"))


@query(_CLASSES + "SELECT doc_id, class_id FROM m")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document: the least id of those with its set of five-word shingles."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(F.array_sort(T.word_shingles(F.col("text")))).alias("content"))
    least = rows.groupBy("content").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "content").select("doc_id", "class_id")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS record FROM conversations GROUP BY conv_id")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.chat_records(table(spark, sf_dir, "conversations"))
    said = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("n_turns"), F.array_join(said, "\n").alias("record"))


_TERMS = (
    "t AS (SELECT doc_id AS key, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7F\\P{L}]', '_', 'g'), '\\b[a-z0-9.#]+\\b')) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),"
    " idf AS (SELECT term, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM t, n GROUP BY term, n), raw AS (SELECT key, term, tf * idf AS raw FROM t JOIN idf USING (term)), norm AS (SELECT key, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY key),"
    " c AS (SELECT item_id AS claim, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^\\x00-\\x7F\\P{L}]', '_', 'g'), '\\b[a-z0-9.#]+\\b')) AS term FROM benchmark) GROUP BY ALL), cr AS (SELECT claim, term, tf * idf AS raw FROM c JOIN idf USING (term)),"
    " cn AS (SELECT claim, sqrt(sum(raw * raw)) AS norm FROM cr GROUP BY claim),"
    " sc AS (SELECT cr.claim, raw.key, round(sum(cr.raw / cn.norm * raw.raw / norm.norm), 4) AS score FROM cr JOIN cn USING (claim) JOIN raw ON raw.term = cr.term JOIN norm ON norm.key = raw.key GROUP BY cr.claim, raw.key) "
)


@query("WITH " + _TERMS + "SELECT claim, key, score, CAST(row_number() OVER (PARTITION BY claim ORDER BY score DESC, key) AS INTEGER) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 8")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight documents nearest to each benchmark passage."""
    return evidence.search(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "doc_id", "text", k=8)


@query()
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as claims against the triples of the documents."""
    rules = evidence.facts_table(spark, FACTS).select(F.xxhash64("head", "relation", "tail").alias("id"), "head", "relation", "tail", "aliases")
    kept = evidence.merge_relations(triples(spark, sf_dir)).select("head", "relation", "tail")
    return evidence.gate(table(spark, sf_dir, "benchmark"), "item_id", "text", rules.join(kept, ["head", "relation", "tail"], "left_semi"))


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),"
    " s AS (SELECT query_id, vec_id AS key, round(list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)), 4) AS score FROM q, e WHERE vec_id <> query_id)"
    " SELECT query_id, key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every one whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return evidence.dense_top(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 10)


@query("SELECT item_id, CAST(len(list_distinct(list_transform(range(1, length(text) - 3), lambda i: substring(text, i, 5)))) AS INTEGER) AS shingles FROM benchmark WHERE length(text) >= 5")
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").where(F.length("text") >= 5)
    return rows.select("item_id", F.size(T.char_shingles(F.col("text"), 5)).alias("shingles"))


_PERMS = contamination.universal_perms(4)
_MINIMA = ", ".join(f"CAST(min((x * {a} + {b}) % {hashing.MERSENNE_61}) AS BIGINT) AS m{i}" for i, (a, b) in enumerate(_PERMS))


@query(
    "WITH s AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 4, 1) + 1), lambda i: substring(text, i, 5)))) AS s FROM benchmark),"
    f" v AS (SELECT item_id, CAST(('0x' || left(md5(s), 16))::UBIGINT AS HUGEINT) % {hashing.MERSENNE_61} AS x FROM s) SELECT item_id, {_MINIMA} FROM v GROUP BY item_id"
)
def universal_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four places of passages' signatures: least universal hashes of the MD5 of their shingles, by built-in functions alone."""
    rows = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.explode(T.char_shingles(F.col("text"), 5)).alias("s"))
    hashed = rows.select("item_id", hashing.md5_64(F.col("s")).alias("x"))
    return hashed.groupBy("item_id").agg(*[F.min(hashing.universal(F.col("x"), a, b)).cast("bigint").alias(f"m{i}") for i, (a, b) in enumerate(_PERMS)])


_STEM = (
    "CASE WHEN length(w) <= 4 THEN w WHEN ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'ing') THEN CASE WHEN ends_with(left(w, length(w) - 3), 'e') THEN left(w, length(w) - 3) || 'e' ELSE left(w, length(w) - 3) END"
    " WHEN ends_with(w, 'ed') THEN CASE WHEN ends_with(left(w, length(w) - 2), 'd') THEN left(w, length(w) - 1) ELSE left(w, length(w) - 2) END WHEN ends_with(w, 'es') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END"
)
_STOPPED = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"SELECT stem, count(*) AS n FROM (SELECT {_STEM} AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9.#]+')) AS w FROM benchmark) WHERE w NOT IN ({_STOPPED})) GROUP BY stem")
def token_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9.#]+"), F.lit(0))
    rows = table(spark, sf_dir, "benchmark").select(F.explode(found).alias("w")).where(~F.col("w").isin(*T.STOPWORDS))
    return rows.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


_SEEN = "reverse(substring(text, CAST(i AS BIGINT) + 1, CAST(least(i + 800, n) - i AS BIGINT)))"
_BORDER = " greatest({})".format(", ".join(f"CASE WHEN instr({_SEEN}, {m}) > 0 THEN least(i + 800, n) - instr({_SEEN}, {m}) - 1 ELSE i - 1 END" for m in ("chr(10) || chr(10)", "' .'")))
_ENDED = f"SELECT doc_id, chunk, i, n, text, CASE WHEN n <= 800 OR i + 800 >= n THEN n WHEN {_BORDER} > i + n * 0.25 THEN {_BORDER} + 1 ELSE i + 800 END AS e FROM "


@query(
    f"WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), c AS ({_ENDED} (SELECT doc_id, 0 AS chunk, CAST(0 AS BIGINT) AS i, n, text FROM d)"
    f" UNION ALL {_ENDED} (SELECT doc_id, chunk + 1 AS chunk, greatest(e - 80, i + 720) AS i, n, text FROM c WHERE e < n))"
    " SELECT doc_id, chunk, CAST(e - i AS INTEGER) AS n_chars, sha256(substring(text, CAST(i AS BIGINT) + 1, CAST(e - i AS BIGINT))) AS signature FROM c"
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 200 tokens that overlap by 20."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunked(F.col("text"), 200, 20)).alias("chunk", "piece"))
    return rows.select("doc_id", "chunk", F.length("piece").alias("n_chars"), F.sha2("piece", 256).alias("signature"))


@query(
    VERIFIED + "SELECT task_id, CASE k % 4 WHEN 3 THEN NULL WHEN 2 THEN left(verdict, length(verdict) - 1) ELSE verdict END AS verdict, CASE WHEN k % 4 <> 3 AND kind <> 'MATCH' THEN kind END AS exception_type,"
    " CASE WHEN k % 4 <> 3 THEN severity END AS severity FROM verified"
)
def repair_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts read back from replies that are fenced, chatty or cut off."""
    rows = verified(spark, sf_dir).select("k", "task_id", "kind", "verdict", "severity", "resolution", "reason")
    whole = split.verdict_json(F.col("verdict"), F.when(F.col("kind") != "MATCH", F.col("kind")), F.col("severity"), F.col("resolution"), F.col("reason"))
    told = F.when(F.col("k") % 4 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("k") % 4 == 1, F.concat(F.lit("My verdict {is}: "), whole, F.lit(" I am sure.")))
    told = told.when(F.col("k") % 4 == 2, F.left(whole, F.length(whole) - 3)).otherwise("no verdict here")
    return rows.select("task_id", repair.parse_verdict(told).alias("v")).select("task_id", "v.verdict", "v.exception_type", "v.severity")


@query("SELECT CASE WHEN NOT (quality IN (0, 1)) THEN 'quality' WHEN NOT (toxic IN (0, 1)) THEN 'toxic' ELSE 'sound' END AS state, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels GROUP BY state")
def labels_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(~F.col("quality").isin(0, 1), "quality").when(~F.col("toxic").isin(0, 1), "toxic").otherwise("sound")
    return table(spark, sf_dir, "labels").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
