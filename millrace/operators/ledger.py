"""A ledger of answers: what a provider has said is kept, and no later run asks for it again.

A request is its entity, its fields and its prompt, and a hash of the three is its key. Answers are added task by task: what
a task that has ended wrote stays even if the job around it fails, so the next run asks only for what is missing. Errors
are kept for the run that met them, and asked for again by the next one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.functions.answer_scan import ERROR_KEY
from millrace.operators import enrich
from millrace.operators.numbering import numbered, placed
from millrace.session import shared_dir

SCHEMA = "request_key string, enriched string, failed boolean, run_id string, answered_at timestamp_ntz"
#: Requests in one task. After a failure so many at most are asked again for each task that was at work.
REQUESTS_PER_TASK = 2_000
#: With the second algorithm of Hadoop's committer the file of a task is in its place as soon as the task has ended.
_TASK_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Of keys in hexadecimal digits and of requests that resemble each other, zstd leaves about half of what Spark's default does.
_SMALL = {"compression": "zstd"}


def request_key(entity: Column, fields: Column, prompt: Column) -> Column:
    """The key of a request. A NULL prompt is another request than an empty one."""
    return F.sha2(F.to_json(F.struct(entity.alias("e"), fields.alias("f"), prompt.alias("p"))), 256)


def _joined_by(request_key: Column) -> Column:
    """128 bits of the key, as bytes: what tells requests apart in a join, a quarter of the key's text on its way."""
    return F.unhex(F.left(request_key, F.lit(32)))


def _first(answers: DataFrame, key: str) -> DataFrame:
    """For each ``key`` its first answer, or without one its first error."""
    first = Window.partitionBy(key).orderBy("failed", "answered_at", "run_id", "enriched")
    return answers.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


class Ledger:
    """The answers in a folder that all executors reach. One run at a time may add to it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, folder: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _of_use(self, run_id: str) -> DataFrame:
        return self.rows().where(~F.col("failed") | (F.col("run_id") == run_id))

    def rows(self) -> DataFrame:
        """All that was added, errors too."""
        path, fs = self._path(self.folder)
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def answers(self, run_id: str = "") -> DataFrame:
        """One row for each request: its first answer, or without one the error that run ``run_id`` met."""
        return _first(self._of_use(run_id), "request_key")

    def answers_to(self, asked: DataFrame, key: Column, run_id: str = "") -> DataFrame:
        """The rows of ``asked``, each with ``enriched`` and ``answered_at`` of the request whose key is ``key``."""
        of_use = self._of_use(run_id).withColumn("__by", _joined_by(F.col("request_key"))).drop("request_key")
        answers = _first(of_use, "__by").select("__by", "enriched", "answered_at")
        return asked.withColumn("__by", _joined_by(key)).join(answers, "__by", "left").drop("__by")

    def ask(self, requests: DataFrame, factory: enrich.ProviderFactory, run_id: str, tasks: int | None = None) -> int:
        """Ask for those of the ``requests`` (entity, fields, prompt) that have no answer, each once; returns how many.

        They are dealt to ``tasks`` tasks of equally many. The requests are written once, without their keys, and removed when
        the answers are there.
        """
        known = self.rows().where(~F.col("failed")).select("request_key")
        key = request_key(F.col("entity"), F.col("fields"), F.col("prompt"))
        new = placed(requests.distinct().withColumn("request_key", key).join(known, "request_key", "left_anti").drop("request_key"))
        folder = f"{shared_dir(self.spark)}/requests-{uuid4().hex}"
        try:
            new.write.options(**_SMALL).parquet(folder)
            new = numbered(self.spark.read.schema(new.schema).parquet(folder), enrich.PLACE)
            count = new.count()
            if count:
                self._sweep()
                dealt = enrich.even_runs(new, count, tasks or -(-count // REQUESTS_PER_TASK))
                said = dealt.select(key.alias("request_key"), enrich.scalar_function(factory, None)("entity", "fields", "prompt").alias("enriched"))
                failed = F.json_object_keys("enriched") == F.array(F.lit(ERROR_KEY))
                rows = said.select("request_key", "enriched", failed.alias("failed"), F.lit(run_id).alias("run_id"), F.localtimestamp().alias("answered_at"))
                rows.write.mode("append").options(**_TASK_BY_TASK, **_SMALL).parquet(self.folder)
        finally:
            path, fs = self._path(folder)
            fs.delete(path, True)
        return count

    def _sweep(self) -> None:
        """Let Spark remove the shuffles of steps that are over, which else stay until the driver's collector happens to run."""
        self.spark.sparkContext._jvm.System.gc()


def enrich_kept(
    df: DataFrame,
    columns: Sequence[str],
    fields: Sequence[str],
    factory: enrich.ProviderFactory,
    ledger: Ledger,
    run_id: str,
    prompt: str | Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Every row with its record as JSON in ``enriched`` and the time of the answer in ``answered_at``.

    Answers come from the ledger; what it lacks is asked for first. The rows of a shared entity share one answer.
    """
    prompt = prompt if isinstance(prompt, Column) else F.lit(prompt).cast("string")
    asked = df.withColumns({"__entity": enrich.entity_json(columns), "__fields": F.lit(json.dumps(list(fields))), "__prompt": prompt})
    request = [F.col(f"__{c}").alias(c) for c in ("entity", "fields", "prompt")]
    ledger.ask(asked.select(*request), factory, run_id, tasks)
    ledger._sweep()
    key = request_key(F.col("__entity"), F.col("__fields"), F.col("__prompt"))
    return ledger.answers_to(asked, key, run_id).drop("__entity", "__fields", "__prompt")
