"""Evidence from text: keyword triples, their merge and checks, lexical retrieval and the claim gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .groups import written
from .triggers import holding
from .verify import once

#: Fixed: the graph's vocabulary.
ENTITY_TYPES = ("MessageType", "Field", "PaymentInstruction", "SettlementSystem", "Risk", "Rule", "Instrument", "Workflow", "Currency", "DateConvention")
RELATION_TYPES = ("COVERS", "REQUIRES", "HAS_FIELD", "CONFLICTS_WITH", "TRIGGERS", "APPLIES_TO", "MITIGATES", "RELATED_TO", "COUNTERPART_OF")
#: Fixed: shares of a claim's stems that support or contradict it, and how many a contradiction needs at least.
SUPPORT, CONTRADICT, CONTRADICT_WORDS = 0.35, 0.30, 2
#: Fixed: how sure a field of a message type that is named is.
MESSAGE_CONFIDENCE = 0.8
#: Fixed: words that make a claim a question about relations.
RELATIONAL = ("relation", "relate", "connect", "link", "difference", "between", "counterpart", "equivalent")
FACT = "head string, head_type string, relation string, tail string, tail_type string, triggers array<string>, confidence double, aliases array<string>"


def facts_table(spark: SparkSession, facts: list[tuple]) -> DataFrame:
    """Rules: a fact holds of a document that has all its triggers."""
    return spark.createDataFrame(facts, FACT)


def _prepared(docs: DataFrame, source: str, text: str) -> DataFrame:
    """source, text and the form that terms are looked up in, made once a document."""
    lower = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "mt ", "mt")
    return once(docs, "_lower", lower).select(F.col(source).alias("source"), F.col(text).alias("text"), F.col("_lower").alias("lower"))


def _holding(docs: DataFrame, rules: DataFrame, triggers: Column, source: str, text: str) -> DataFrame:
    """The rows of a rule table that hold of each document, with its source and text; one pass over a text for all rules."""
    spark = rules.sparkSession
    held = rules.select("*", F.transform(triggers, F.lower).alias("_terms")).collect()
    fields = rules.schema.fieldNames()
    numbered = spark.createDataFrame([(i, *[r[f] for f in fields]) for i, r in enumerate(held)], "_rule int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema.fields))
    rows = _prepared(docs, source, text).select("source", "text", F.explode(holding(F.col("lower"), [r["_terms"] for r in held])).alias("_rule"))
    return rows.join(F.broadcast(numbered), "_rule").drop("_rule")


def extract(docs: DataFrame, facts: DataFrame, source: str, text: str) -> DataFrame:
    """One triple for each document and fact whose triggers it has, with the sentence of the first trigger.

    Facts are a rule table that the driver has, of thousands of rules if need be; only documents with a fact make a row.
    """
    found = _holding(docs, facts, F.col("triggers"), source, text)
    return found.select("head", "head_type", "relation", "tail", "tail_type", T.sentence_with(F.col("text"), F.get("triggers", F.lit(0))).alias("evidence"), "confidence", "source", "aliases")


def named(docs: DataFrame, names: tuple[str, ...], kind: str, source: str, text: str) -> DataFrame:
    """Entities of a list (message types, currencies) that a document names: name, type, source, text."""
    rules = docs.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    found = _holding(docs, rules, F.array("name"), source, text)
    return found.select("name", F.lit(kind).alias("type"), "source", "text")


def message_fields(docs: DataFrame, fields: DataFrame, source: str, text: str) -> DataFrame:
    """For each message type that a document names, a HAS_FIELD triple for each of its fields(message_type, tag, label), a rule table."""
    types = tuple(r["message_type"] for r in fields.select("message_type").where("message_type IS NOT NULL").distinct().collect())
    found = named(docs, types, "MessageType", source, text).withColumnRenamed("name", "message_type")
    rows = found.join(F.broadcast(fields), "message_type")
    return rows.select(
        F.col("message_type").alias("head"), F.lit("MessageType").alias("head_type"), F.lit("HAS_FIELD").alias("relation"), F.concat_ws(" ", "tag", "label").alias("tail"), F.lit("Field").alias("tail_type"),
        T.sentence_with(F.col("text"), F.col("message_type")).alias("evidence"), F.lit(MESSAGE_CONFIDENCE).alias("confidence"), "source", F.array().cast("array<string>").alias("aliases"),
    )


def merge_corpus(triples: DataFrame) -> DataFrame:
    """One row for head, relation, tail and source, in order of source; of repeats the most confident, then the first evidence."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "evidence"))
    return triples.groupBy("head", "relation", "tail", "source").agg(best.alias("b")).select(
        "head", "relation", "tail", "source", F.col("b.evidence").alias("evidence"), (-F.col("b.c")).alias("confidence")
    ).orderBy("source", "head", "relation", "tail")


def with_gold(triples: DataFrame, gold: DataFrame) -> DataFrame:
    """Extracted triples and gold ones as one bag; merging decides what stays."""
    return triples.unionByName(gold, allowMissingColumns=True)


def coerce_chunk(reply: Column) -> Column:
    """Entities and relations in a reply of a language model, names trimmed and gaps filled; null where it holds no object."""
    entity = "struct<name:string,type:string>"
    relation = "struct<head:string,relation:string,tail:string,evidence:string,confidence:double>"
    parsed = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), f"entities array<{entity}>, relations array<{relation}>", {"mode": "PERMISSIVE"})
    made = F.struct(
        F.transform(F.coalesce(parsed["entities"], F.array()), lambda e: F.struct(F.trim(e["name"]).alias("name"), F.trim(F.coalesce(e["type"], F.lit(""))).alias("type"))).alias("entities"),
        F.transform(
            F.coalesce(parsed["relations"], F.array()),
            lambda r: F.struct(
                F.trim(r["head"]).alias("head"), F.trim(r["relation"]).alias("relation"), F.trim(r["tail"]).alias("tail"), F.coalesce(r["evidence"], F.lit("")).alias("evidence"), F.coalesce(r["confidence"], F.lit(0.7)).alias("confidence")
            ),
        ).alias("relations"),
    )
    return F.when(parsed.isNotNull() & (parsed["entities"].isNotNull() | parsed["relations"].isNotNull()), made)


def merge_relations(triples: DataFrame) -> DataFrame:
    """One row for head, relation and tail: the most confident, of equals the first source."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "source", "evidence"))
    return triples.groupBy("head", "relation", "tail").agg(best.alias("b")).select(
        "head", "relation", "tail", F.col("b.evidence").alias("evidence"), (-F.col("b.c")).alias("confidence"), F.col("b.source").alias("source")
    )


def entities(triples: DataFrame, last: bool = False) -> DataFrame:
    """One row for name and type, from the first source or the last."""
    both = triples.select(F.col("head").alias("name"), F.col("head_type").alias("type"), "source").union(triples.select("tail", "tail_type", "source"))
    return both.groupBy("name", "type").agg((F.max if last else F.min)("source").alias("source"))


def broken_entities(rows: DataFrame) -> DataFrame:
    """name, type and why: an empty name or an unknown type."""
    empty = F.trim(F.coalesce("name", F.lit(""))) == ""
    why = F.when(empty, "name").when(~F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False)), "type")
    return rows.select("name", "type", why.alias("why")).where("why IS NOT NULL")


def broken(entity_rows: DataFrame, relations: DataFrame) -> DataFrame:
    """head, relation, tail and why: an unknown type, an empty end, a confidence out of bounds, or an end that is no entity."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = (
        F.when(blank("head") | blank("tail"), "empty")
        .when(~F.coalesce(F.col("relation").isin(*RELATION_TYPES), F.lit(False)), "relation")
        .when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence")
    )
    bad = relations.select("head", "relation", "tail", why.alias("why")).where("why IS NOT NULL")
    names = entity_rows.select("name").distinct()
    for end in ("head", "tail"):
        lost = relations.join(names, F.col(end) == F.col("name"), "left_anti").select("head", "relation", "tail", F.lit(end).alias("why"))
        bad = bad.union(lost)
    return bad


def checked(entity_rows: DataFrame, relations: DataFrame) -> DataFrame:
    """relations, or an error where any of them or an entity breaks the graph's rules."""
    wrong = broken(entity_rows, relations).select("why").union(broken_entities(entity_rows).select("why")).agg(F.count(F.lit(1)).alias("n"))
    sound = wrong.select(F.when(F.col("n") > 0, F.raise_error(F.lit("the graph breaks its rules"))).otherwise(F.lit(True)).alias("_sound"))
    return relations.crossJoin(F.broadcast(sound)).where("_sound").drop("_sound")


def terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    return rows.select(F.col(key).alias("key"), F.explode(T.terms(F.col(text))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(rows: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, term, weight) and (term, idf): tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length; texts are read once, terms written.

    With asked(term), weights of these terms alone; lengths are those of all.
    """
    t, _ = written(terms(rows, key, text), "terms")
    n = rows.agg(F.count(F.lit(1)).alias("docs"))
    idf = t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = t.join(idf, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("raw") ** 2)).alias("norm"))
    raw = raw if asked is None else raw.join(asked, "term", "left_semi")
    return raw.join(norm, "key").select("key", "term", (F.col("raw") / F.col("norm")).alias("weight")), idf


#: Scores are rounded to four digits; a bound so much below the k-th score cannot be rounded up to it.  Rows of asked terms that are
#: sent to all tasks, so that no common term's postings meet in one.
MARGIN, SENT_ROWS = 2e-4, 200_000


def _by_term(asked: DataFrame, index: DataFrame) -> DataFrame:
    """claim, key, the sum of what the asked terms have in common with each row, and how much of the row's length they are."""
    return index.join(asked, "term").groupBy("claim", "key").agg(F.sum(F.col("q") * F.col("weight")).alias("part"), F.sum(F.col("weight") ** 2).alias("held"))


def pruned(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """claim, key and score of the rows of index(key, term, weight) that can be among the k best of asked(claim, term, q).

    Some terms add at most the sum of q times each one's greatest weight, and, rows being of length 1, at most the length
    of their q times what of a row's length other terms have left.  The rows of a claim's rarest terms give it a k-th
    score, theta, that its k best reach; the most common terms, as many as together cannot reach it, are not essential: a
    row with none of the others is no candidate, so the postings of common terms are not gone through.  Of the rows met
    those stay whose essential terms reach theta with all that the others could add.
    """
    greatest = index.groupBy("term").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("df"))
    asked = asked.join(greatest, "term").select("claim", "term", "q", (F.col("q") * F.col("most")).alias("bound"), "df")
    by = W.partitionBy("claim")
    before = F.coalesce(F.sum("df").over(by.orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = asked.withColumn("before", before).where(F.col("before") < 4 * k)
    met = _by_term(first, index).withColumn("nth", F.row_number().over(by.orderBy(F.col("part").desc(), "key"))).where(F.col("nth") <= k)
    whole = met.select("claim", "key").join(asked, "claim").join(index, ["key", "term"]).groupBy("claim", "key").agg(F.sum(F.col("q") * F.col("weight")).alias("score"))
    theta = whole.groupBy("claim").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("theta"))
    common = by.orderBy(F.col("df").desc(), "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = asked.join(theta, "claim").withColumn("upto", F.least(F.sum("bound").over(common), F.sqrt(F.sum(F.col("q") ** 2).over(common))))
    told, _ = written(ranked.withColumn("essential", F.col("upto") >= F.col("theta") - MARGIN), "asked")
    none = lambda x: F.coalesce(F.sum(F.when(~F.col("essential"), x)), F.lit(0.0))
    rest = told.groupBy("claim").agg(none(F.col("bound")).alias("rest"), F.sqrt(none(F.col("q") ** 2)).alias("length"), F.max("theta").alias("theta"))
    essential = told.where("essential").select("claim", "term", "q")
    essential = F.broadcast(essential) if essential.count() <= SENT_ROWS else essential
    more = F.least(F.col("rest"), F.col("length") * F.sqrt(F.greatest(1 - F.col("held"), F.lit(0.0))))
    kept = _by_term(essential, index).join(rest, "claim").where(F.col("part") + more >= F.col("theta") - MARGIN)
    others = told.where("NOT essential").select("claim", "term", "q")
    more = kept.select("claim", "key").join(others, "claim").join(index, ["key", "term"]).groupBy("claim", "key").agg(F.sum(F.col("q") * F.col("weight")).alias("more"))
    return kept.join(more, ["claim", "key"], "left").select("claim", "key", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))


def search(claims: DataFrame, claim: str, text: str, rows: DataFrame, key: str, row_text: str, k: int = 8) -> DataFrame:
    """The k rows nearest to each claim by cosine of tf-idf, score over 0, ties to the smaller key.

    An inverted index, written once: claims meet rows on shared terms only, and on common ones only where these can matter.
    """
    claimed, _ = written(terms(claims, claim, text), "claimed")
    wanted, _ = written(claimed.select("term").distinct(), "asked-terms")
    index, idf = tfidf(rows, key, row_text, wanted)
    index, _ = written(index, "postings")
    asked = claimed.join(idf, "term").select(F.col("key").alias("claim"), "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = asked.groupBy("claim").agg(F.sqrt(F.sum(F.col("raw") ** 2)).alias("norm"))
    asked, _ = written(asked.join(norm, "claim").select("claim", "term", (F.col("raw") / F.col("norm")).alias("q")), "claims")
    scored = pruned(asked, index, k).select("claim", "key", F.round("score", 4).alias("score")).where("score > 0")
    order = W.partitionBy("claim").orderBy(F.col("score").desc(), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coverage(claim: Column, other: Column) -> Column:
    """(overlap, share of the claim's stems)."""
    c = T.stems(claim)
    overlap = F.size(F.array_intersect(c, T.stems(other)))
    return F.struct(overlap.alias("overlap"), F.when(F.size(c) == 0, 0.0).otherwise(overlap / F.size(c)).alias("coverage"))


def said(triples: DataFrame) -> DataFrame:
    """triples with told, the words that claims are held against."""
    return triples.withColumn("told", F.concat_ws(" ", "head", "relation", "tail", T.split_name(F.col("head")), T.split_name(F.col("tail")), F.array_join("aliases", " ")))


def gate(claims: DataFrame, claim: str, text: str, triples: DataFrame, k: int = 8) -> DataFrame:
    """SUPPORT, CONTRADICT or SILENT for each claim from its k nearest triples(id, head, relation, tail)."""
    named, _ = written(said(triples), "told")
    near = search(claims, claim, text, named, "id", "told", k)
    rows = near.join(named.select(F.col("id").alias("key"), "head", "relation", "tail", "told"), "key").join(claims.select(F.col(claim).alias("claim"), F.col(text).alias("text")), "claim")
    rows = rows.withColumn("c", coverage(F.col("text"), F.col("told")))
    mine = T.stems(F.col("text"))
    about = F.size(F.array_intersect(mine, T.stems(F.col("head")))) > 0
    asks = F.arrays_overlap(mine, F.transform(F.array(*map(F.lit, RELATIONAL)), T.stem))
    conflict = F.col("relation") == "CONFLICTS_WITH"
    best = rows.groupBy("claim").agg(
        F.max(F.when(conflict & about & ~asks, F.struct("c.coverage", "c.overlap", (-F.col("rank")).alias("at"), "key"))).alias("against"),
        F.max(F.when(~conflict, F.struct("c.coverage", (-F.col("rank")).alias("at"), "key"))).alias("for"),
        F.min(F.struct("rank", "key")).alias("first"),
    )
    no = F.coalesce((F.col("against.overlap") >= CONTRADICT_WORDS) & (F.col("against.coverage") >= CONTRADICT), F.lit(False))
    yes = F.coalesce(F.col("for.coverage") >= SUPPORT, F.lit(False))
    judged = best.select(
        "claim",
        F.when(no, "CONTRADICT").when(yes, "SUPPORT").otherwise("SILENT").alias("verdict"),
        F.when(no, F.col("against.key")).when(yes, F.col("for.key")).otherwise(F.col("first.key")).alias("evidence_id"),
        F.round(F.when(no, F.col("against.coverage")).when(yes, F.col("for.coverage")).otherwise(0.0), 4).alias("coverage"),
    )
    return claims.select(F.col(claim).alias("claim")).join(judged, "claim", "left").withColumn("verdict", F.coalesce("verdict", F.lit("SILENT")))


def build_claim(ledger: Column, statement: Column, verdict: Column, kind: Column, severity: Column, reason: Column) -> Column:
    """Fixed: the sentence by which a pair and its provisional verdict are put to the gate."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    told = lambda before, c: F.concat(F.lit(before), some(c))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Ledger message "), F.coalesce(some(ledger["message_type"]), F.lit("UNKNOWN")), F.lit(" against statement message "), F.coalesce(some(statement["message_type"]), F.lit("UNKNOWN"))),
        F.rtrim(F.concat(told("for ", ledger["amount"]), F.lit(" "), F.coalesce(ledger["ccy"], F.lit("")))),
        told("with value date ", ledger["value_date"]),
        told("has provisional verdict ", verdict),
        told("with exception ", kind),
        told("severity ", severity),
        told("reason: ", reason),
    )


def evidence_entry(row: Column) -> Column:
    """What a verdict shows of a triple that it rests on."""
    return F.struct(F.concat_ws(" ", row["head"], row["relation"], row["tail"]).alias("triple"), row["source"].alias("source"), row["evidence"].alias("text"), F.round(row["confidence"], 4).alias("confidence"))


#: Words of all triples up to which claims are told apart by these words alone.
VOCABULARY = 20_000


def _forms(text: Column, told: DataFrame) -> Column:
    """What the gate looks at in a claim: which of the triples' terms it has and how often, which of their stems, and how many stems in all.

    ``told`` has what triples say.  Where they say more than a bounded number of words, the form of a claim is its text.
    """
    asked = F.array(*map(F.lit, RELATIONAL))
    word = told.select(F.explode(F.array_distinct(F.concat(T.terms(F.col("told")), T.stems(F.col("told")), T.stems(F.col("head"))))).alias("w"))
    known = [r["w"] for r in word.distinct().limit(VOCABULARY + 1).collect()]
    if len(known) > VOCABULARY:
        return F.struct(text)
    held = F.concat(F.lit(known).cast("array<string>"), F.transform(asked, T.stem))
    ours = F.transform(F.array(T.terms(text)), lambda t: F.transform(F.array(F.array_intersect(t, held)), lambda few: F.array_sort(F.filter(t, lambda x: F.array_contains(few, x)))))
    stems = F.transform(F.array(T.stems(text)), lambda s: F.struct(F.array_sort(F.array_intersect(s, held)), F.size(s)))
    return F.struct(ours, stems)


def ground_pairs(pairs: DataFrame, key: str, triples: DataFrame, k: int = 8) -> DataFrame:
    """claim and verdict of each pair; claims that are equal in all that the gate looks at are judged once.

    Amounts, dates and references are in no triple, so claims have few forms, however many pairs there are.
    """
    triples, _ = written(triples, "graph")  # what follows asks for them several times
    kind = F.when(F.col("kind") != "MATCH", F.col("kind"))
    told = pairs.select(key, build_claim(F.col("ledger"), F.col("statement"), F.col("verdict"), kind, F.col("severity"), F.col("reason")).alias("text"))
    told, _ = written(once(told, "form", F.sha2(F.to_json(F.struct(_forms(F.col("text"), said(triples)).alias("f"))), 256)), "claim-texts")
    claims, _ = written(told.groupBy("form").agg(F.min("text").alias("text")), "claim-forms")
    judged, _ = written(gate(claims, "form", "text", triples, k), "claims-judged")
    return told.join(judged, F.col("form") == F.col("claim")).select(key, F.col("text").alias("claim"), "verdict", "evidence_id", "coverage")


def probe_agreement(probes: DataFrame, triples: DataFrame, k: int = 8, first: int | None = None, ids: tuple[str, ...] = ()) -> DataFrame:
    """id, target, verdict and agrees of probes(id, question, target): all, the first so many by id, or those named."""
    asked = probes.where(F.col("id").isin(*ids)) if ids else probes
    asked = asked.orderBy("id").limit(first) if first else asked
    judged = gate(asked.select("id", "question"), "id", "question", triples, k)
    return asked.join(judged, F.col("id") == F.col("claim")).select("id", "target", "verdict", (F.col("verdict") == F.col("target")).alias("agrees"))


#: Vectors of a shard and of a query block that meet in a task.
SHARD_ROWS, BLOCK_ROWS = 16_384, 2_048


def _cosines(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and asked.num_rows:
            order = pc.sort_indices(rows["key"])
            names = rows["key"].take(order).to_pylist()
            stacked = lambda c: np.stack([np.asarray(v, float) for v in c.to_pylist()])
            x, q = stacked(rows["v"].take(order)), stacked(asked["q"])
            size = np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))[None, :]
            score = np.round(np.divide(q @ x.T, size, out=np.zeros(size.shape), where=size > 0), 4)
            for i, name in enumerate(asked["query_id"].to_pylist()):
                best = [j for j in np.argsort(-score[i], kind="stable")[: k + 1].tolist() if names[j] != name][:k]
                out[0].extend([name] * len(best))
                out[1].extend(names[j] for j in best)
                out[2].extend(score[i][best].tolist())
        kind = asked.schema.field("query_id").type
        return pa.table({"query_id": pa.array(out[0], kind), "key": pa.array(out[1], kind), "score": pa.array(out[2], pa.float64())})

    return run


def dense_top(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Cosine top k of each query against all rows but itself, ties to the smaller key.

    Queries in blocks meet rows in shards, both of bounded size; each meeting sends k rows a query to the last ranking.
    Null vectors take no part; keys are unique and vectors of one length.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    held = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    n, m = held.count(), asked.count()
    shards = max(-(-n // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)), 1)
    blocks = max(1, -(-m // BLOCK_ROWS))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    held = held.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), every(blocks).alias("block"))
    asked = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), every(shards).alias("shard"))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_cosines(k), f"query_id {kind}, key {kind}, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
