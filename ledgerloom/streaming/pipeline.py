"""The event pipeline: pairs in, routed verdicts, an idempotent ledger, letters that wait for another try and dead ones out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.routing import route, route_reason, violations
from ..operators.verify import verify
from ..sources.pairs import PAIR
from ..sources.shared import exists, filesystem, remove
from .ledger_log import LedgerLog

INCOMING = PAIR + ", event_id string, created_at timestamp"
#: A letter that waits: what came, what was wrong with it, which try it was and when the next one is due.
LETTER = "payload string, codes array<string>, attempt int, retry_at timestamp"
ENTRY = "task_id string, created_at timestamp, event_id string, verdict string, kind string, severity string, source string, route string, why string"
#: Which tables an entry goes on to, by its route.
ROUTES = (("escalations", "route = 'ESCALATE'"), ("exceptions", "route = 'EXCEPTION'"), ("verdicts", "route IN ('EXCEPTION', 'VERDICT')"))


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """A folder in which files of pairs arrive, as a stream; lines that do not parse keep their text."""
    return spark.readStream.schema(INCOMING + ", _corrupt_record string").json(path)


def again(spark: SparkSession, path: str) -> DataFrame:
    """Letters that are tried again, as a stream of the same rows with the number of the try."""
    letters = spark.readStream.schema("payload string, attempt int").parquet(path)
    schema = INCOMING + ", _corrupt_record string"
    read = letters.select("attempt", F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return read.select("r.*", "attempt")


def decide(pairs: DataFrame, threshold: float = 0.6, severities: tuple[str, ...] = ("HIGH",)) -> DataFrame:
    """Verified pairs with confidence 1, their route and its reason; works on streams and tables."""
    rows = verify(pairs).withColumn("confidence", F.lit(1.0))
    to = (F.col("verdict"), F.col("severity"), F.col("confidence"))
    return rows.withColumns({"route": route(*to, threshold, severities), "why": route_reason(*to, threshold, severities)})


def ledger(spark: SparkSession, target: str) -> LedgerLog:
    """The ledger of a pipeline; ``read()`` gives its entries."""
    return LedgerLog(spark, f"{target}/ledger", StructType.fromDDL(ENTRY), "task_id", "created_at", "event_id")


def _wait(attempt: Column, seconds: float) -> Column:
    """Twice as long after each try."""
    return F.make_dt_interval(secs=F.lit(seconds) * F.pow(F.lit(2), attempt - 1))


def run(spark: SparkSession, source: str, target: str, checkpoint: str, attempts: int = 1, backoff_s: float = 60, now=None) -> StreamingQuery:
    """Drains a folder of pairs, and the letters that ``requeue`` has put back, into ``target``.

    The ledger takes the first entry of each task only, so a batch that is run again adds nothing, and only what it
    takes is routed on.  What breaks the contract waits for another try, longer after each; after ``attempts`` tries it
    is dead: it goes to ``dead`` with its codes and, if it has a task, the ledger gets an entry of the system's for it, an
    escalation of a corrupt record.  A batch is checked and verified once, into ``work``, from which its tables are made.
    """
    fs, at = filesystem(spark, f"{target}/again")
    fs.mkdirs(at)
    log, when = ledger(spark, target), F.current_timestamp() if now is None else F.lit(now)

    def land(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("codes", violations(batch))
        bad = F.col("_corrupt_record").isNotNull() | (F.size("codes") > 0)
        work = f"{target}/work/batch={number}"
        own = F.struct(*[F.col(c) for c in batch.columns if c not in ("_corrupt_record", "attempt")])
        letter = F.struct(
            F.coalesce("_corrupt_record", F.to_json(own)).alias("payload"), "codes", "attempt", (when + _wait(F.col("attempt"), backoff_s)).alias("retry_at"), "task_id", F.col("_corrupt_record").alias("_raw")
        )
        lit = lambda value, name: F.lit(value).alias(name)
        routed = decide(checked.where(~bad).drop("codes", "_corrupt_record"))
        good = routed.select("task_id", "created_at", "event_id", "verdict", F.when(F.col("kind") != "MATCH", F.col("kind")).alias("kind"), "severity", lit("model", "source"), "route", "why")
        last = F.col("attempt") >= attempts
        wrong = checked.where(bad).select(
            F.when(last, F.col("task_id")).alias("task_id"), "created_at", "event_id", lit("ESCALATE", "verdict"), lit("FIELD_CORRUPTION", "kind"), lit("LOW", "severity"), lit("system", "source"), lit("DEAD", "route"),
            F.array_join("codes", ",").alias("why"), letter.alias("letter"), last.alias("dead"),
        )
        good.unionByName(wrong, allowMissingColumns=True).write.mode("overwrite").parquet(work)
        kept = spark.read.parquet(work)
        letters = kept.where("letter IS NOT NULL")
        letters.where("NOT dead").select("letter.payload", "letter.codes", "letter.attempt", "letter.retry_at").write.mode("overwrite").parquet(f"{target}/waiting/batch={number}")
        letters.where("dead").select("letter.task_id", "letter.codes", F.col("letter._raw").alias("_corrupt_record"), "letter.attempt").write.mode("overwrite").parquet(f"{target}/dead/batch={number}")
        taken = log.append(number, kept.where("task_id IS NOT NULL"))
        for name, keep in ROUTES:
            taken.where(keep).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        remove(spark, work)

    rows = incoming(spark, source).withColumn("attempt", F.lit(1)).unionByName(again(spark, f"{target}/again"))
    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requeue(spark: SparkSession, target: str, now=None, mend: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Puts letters that are due back on the stream, mended by ``mend(letters)`` if given; how many there were.

    What is put back is noted after it is; if that is lost in between, a letter is tried twice, which the ledger
    does not notice.
    """
    if not exists(spark, f"{target}/waiting"):
        return 0
    waiting = spark.read.schema(LETTER + ", batch long").parquet(f"{target}/waiting").withColumn("id", F.sha2(F.concat_ws("|", "batch", "attempt", "payload"), 256))
    due = waiting.where(F.col("retry_at") <= (F.current_timestamp() if now is None else F.lit(now)))
    if exists(spark, f"{target}/requeued"):
        due = due.join(spark.read.schema("id string").parquet(f"{target}/requeued"), "id", "left_anti")
    due = due.dropDuplicates(["id"])
    due.select("id", "payload", "codes", "attempt").write.mode("overwrite").parquet(f"{target}/work/due")
    held = spark.read.parquet(f"{target}/work/due")
    n = held.count()
    if n:
        letters = mend(held) if mend else held
        letters.select("payload", (F.col("attempt") + 1).cast("int").alias("attempt")).write.mode("append").parquet(f"{target}/again")
        held.select("id").write.mode("append").parquet(f"{target}/requeued")
    return n
