"""Questions and new values as streams: write-through with versions, stored answers, and the lifecycle as ordered stage rows.

Everything a micro-batch changes goes to one folder named by the number of the batch, which a replay overwrites, so a batch that runs again after a
failure changes nothing. The state is read from these folders: the last value of a key, and the number of values of a subject as its
version. ``compact`` folds the folders of old batches into one table. A stored answer holds the version that its subject had; the version is part of what it is
looked up by, so an answer made before a write is not found after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import routing
from ..operators import lifecycle
from ..operators.records import lab_flag
from ..sources.files import _exists
from ..sources.shared import saved
from .state import answer_tokens

CHANGES = "key string, value string, subject string, seq string, batch long"
ANSWERS = "answer_key string, subject string, version long, status string, route string, reason string, answer string, grounding_rate double, batch long"
EVENTS = "qid long, seq int, event string, data string, batch long"
VERSION = "meta:version:"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


@dataclass
class Store:
    """Records (key, value), the versions of subjects and stored answers below one path on shared storage."""

    spark: SparkSession
    path: str

    # --- records
    def _base(self) -> tuple[int, DataFrame]:
        """The newest compacted table that is complete, and the last batch in it."""
        schema = "key string, value string, subject string"
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/base")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n.removeprefix("upto=")) for n in names if n.startswith("upto=") and fs.exists(hadoop.Path(f"{self.path}/base/{n}/_SUCCESS"))]
        if not done:
            return -1, self.spark.createDataFrame([], schema)
        return max(done), self.spark.read.schema(schema).parquet(f"{self.path}/base/upto={max(done)}")

    def records(self, upto: int | None = None) -> DataFrame:
        """(key, value, subject): the last value of each key, and a row ``meta:version:{subject}`` for each subject; of all batches or those up to a number."""
        last, base = self._base()
        log = _read(self.spark, f"{self.path}/changes", CHANGES).where(F.col("batch") > last)
        log = log if upto is None else log.where(F.col("batch") <= upto)
        is_version = F.col("key").startswith(VERSION)
        values = base.where(~is_version).select("key", "value", "subject", F.lit(-1).cast("long").alias("batch"), F.lit("").alias("seq")).unionByName(log.select("key", "value", "subject", "batch", "seq"))
        newest = values.groupBy("key").agg(F.max_by(F.struct("value", "subject"), F.struct("batch", "seq", "value")).alias("v")).select("key", "v.value", "v.subject")
        raised = base.where(is_version).select("subject", F.col("value").cast("long").alias("n")).unionByName(log.groupBy("subject").agg(F.count(F.lit(1)).alias("n")))
        versions = raised.groupBy("subject").agg(F.sum("n").alias("n")).select(F.concat(F.lit(VERSION), "subject").alias("key"), F.col("n").cast("string").alias("value"), "subject")
        return newest.unionByName(versions)

    def versions(self) -> DataFrame:
        """(subject, version) of the subjects that have any value."""
        return self.records().where(F.col("key").startswith(VERSION)).select("subject", F.col("value").cast("long").alias("version"))

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """rows: key, value, subject, seq (text that orders values of one key). A batch that is put again replaces itself."""
        rows.select("key", "value", "subject", "seq").write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def compact(self, upto: int) -> None:
        """Fold the batches up to this number into one table. Their folders may be removed once nobody reads them."""
        if upto > self._base()[0]:
            self.records(upto).write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")

    # --- stored answers
    def keyed(self, questions: DataFrame) -> DataFrame:
        """Questions (qid, query, scope) with ``answer_key`` and the ``version`` of their subject."""
        subject = F.coalesce("scope", F.get(routing.patient_ids(F.col("query")), F.lit(0)))
        q = questions.withColumn("subject", subject).join(self.versions(), "subject", "left").withColumn("version", F.coalesce("version", F.lit(0)))
        none = F.lit(None).cast("string")
        return q.withColumn("answer_key", routing.cache_key(routing.normalize(F.col("query")), F.col("subject"), none, F.array().cast("array<string>"), none, F.col("version")))

    def stored(self, before: int | None = None) -> DataFrame:
        """One answer for each key, of several batches the first; of all batches or those before a number."""
        rows = _read(self.spark, f"{self.path}/answers", ANSWERS)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        w = Window.partitionBy("answer_key").orderBy("batch")
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")

    def keep(self, answers: DataFrame, batch_id: int) -> None:
        answers.write.mode("overwrite").parquet(f"{self.path}/answers/batch={batch_id}")

    def events(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/events", EVENTS)


def lab_rows(labs: DataFrame) -> DataFrame:
    """New lab values (patient_id, lab, date, value) as rows for ``Store.put``; of several values of a day the greatest comes last."""
    slug = F.btrim(F.regexp_replace(F.lower("lab"), "[^a-z0-9]+", "_"), F.lit("_"))
    value = F.to_json(F.struct("date", lab_flag(F.col("lab"), F.col("value")).alias("flag"), "lab", "value"))
    return labs.select(F.concat_ws(":", F.lit("patient"), "patient_id", F.lit("lab"), slug, "date").alias("key"), value.alias("value"), F.col("patient_id").alias("subject"), F.format_string("%030.6f", F.col("value").cast("double")).alias("seq"))


def write_stream(labs: DataFrame, store: Store, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """Writes a stream of lab values through to the store; values of unknown subjects (known: patient_id) are left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        there = batch if known is None else batch.join(known.select("patient_id").distinct(), "patient_id", "left_semi")
        store.put(lab_rows(there), batch_id)

    return labs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_rows(run: lifecycle.Run) -> DataFrame:
    """(qid, seq, event, data): of every question ``meta``, then ``retrieval`` where anything was looked for, a ``token`` for each piece of the answer, and ``final``."""
    q, final = run.questions, run.final
    meta = q.select("qid", F.lit(0).alias("seq"), F.lit("meta").alias("event"), F.to_json(F.struct("route", "status", "subject", F.col("spaces").alias("namespaces"))).alias("data"))
    counts = run.evidence.groupBy("qid").agg(F.count_if(F.col("origin") == "kv").alias("records"), F.count_if(F.col("origin") != "kv").alias("chunks"), F.array_sort(F.collect_list(F.struct(F.substr("key", F.lit(2)).cast("int").alias("n"), "id"))).alias("ids"))
    looked = q.where("status is null").select("qid").join(counts, "qid", "left").join(run.report, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    retrieval = looked.select("qid", F.lit(1).alias("seq"), F.lit("retrieval").alias("event"), F.to_json(F.struct(zero("records"), zero("chunks"), F.transform("ids", lambda x: x["id"]).alias("ids"), "searched", "skipped", zero("blocked"))).alias("data"))
    pieces = answer_tokens(final.where("answer is not null"), "qid")
    token = pieces.select("qid", (F.col("pos") + 2).alias("seq"), F.lit("token").alias("event"), F.to_json(F.struct(F.col("piece").alias("text"))).alias("data"))
    n = F.coalesce(F.regexp_count("answer", F.lit(r"\S+\s*")), F.lit(0))
    early = F.col("status").isin("red_flag", "out_of_scope", "violation")  # nothing was looked for
    last = final.select("qid", F.when(early, 1).otherwise(n + 2).alias("seq"), F.lit("final").alias("event"), F.to_json(F.struct("status", "route", "reason", "answer", "grounding_rate")).alias("data"))
    return meta.unionByName(retrieval).unionByName(token).unionByName(last)


def answer_batch(questions: DataFrame, store: Store, batch_id: int, run: Callable[[DataFrame], lifecycle.Run]) -> None:
    """Answers one batch of questions (qid, query, scope) and writes its stage rows. Malformed requests get one ``error`` row. Questions whose answer is stored under the present version of
    their subject get ``meta`` and ``final`` from it; all others go through the lifecycle, each question once, and what is answered is stored."""
    problem = routing.request_problem(F.col("query"), F.col("scope"), F.lit(5))
    judged = questions.select("qid", "query", "scope", problem.alias("problem"))
    fit = saved(store.keyed(judged.where("problem is null").drop("problem")), "asked")
    # What this batch stored in an earlier try does not count: a replay does the same work again.
    known = store.stored(before=batch_id).select("answer_key", "status", "route", "reason", "answer", "grounding_rate")
    hits = saved(fit.join(known, "answer_key"), "hits")
    missed = fit.join(hits.select("qid"), "qid", "left_anti")
    lead = saved(missed.groupBy("answer_key").agg(F.min_by(F.struct("qid", "query", "scope", "subject", "version"), "qid").alias("q")).select("answer_key", "q.*"), "leads")
    done = run(lead.select("qid", "query", "scope"))
    final = saved(done.final, "final")
    done = lifecycle.Run(done.questions, done.report, done.evidence, final)
    rows = stage_rows(done)
    # Questions that were asked several times share the stages of the first.
    told = missed.select("qid", "answer_key").join(lead.select("answer_key", F.col("qid").alias("lead")), "answer_key").join(rows.withColumnRenamed("qid", "lead"), "lead").select("qid", "seq", "event", "data")
    cached = hits.select("qid", F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("meta").alias("event"), F.to_json(F.struct("route", "subject", F.lit("exact").alias("cache"))).alias("data")),
        F.struct(F.lit(1).alias("seq"), F.lit("final").alias("event"), F.to_json(F.struct("status", "route", "reason", "answer", "grounding_rate")).alias("data")),
    )).alias("x")).select("qid", "x.*")
    failed = judged.where("problem is not null").select("qid", F.lit(0).alias("seq"), F.lit("error").alias("event"), F.to_json(F.struct(F.col("problem").alias("detail"))).alias("data"))
    told.unionByName(cached).unionByName(failed).select(F.col("qid").cast("long"), F.col("seq").cast("int"), "event", "data").write.mode("overwrite").parquet(f"{store.path}/events/batch={batch_id}")
    answered = final.where("status = 'answered'").join(lead.select("qid", "answer_key", "subject", "version"), "qid")
    store.keep(answered.select("answer_key", "subject", "version", "status", "route", "reason", "answer", "grounding_rate"), batch_id)


def answer_stream(questions: DataFrame, store: Store, checkpoint: str, run: Callable[[DataFrame], lifecycle.Run]) -> StreamingQuery:
    """A stream of questions through the lifecycle; ``run`` maps a batch of questions to its stages, with the store's records as they are then."""
    return questions.writeStream.foreachBatch(lambda batch, batch_id: answer_batch(batch, store, batch_id, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
