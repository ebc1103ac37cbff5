"""Claims of queue rows as a stream of requests against versioned state, with fencing.

Every start of the query takes the next epoch. A micro-batch reads the latest version of the state, deals due rows to its
requests, and writes the next version and the grants under its own epoch; one row appended to a manifest makes both count. A batch
that is repeated finds its row and changes nothing; one that was killed left no row. A writer that was replaced is refused
when it sees the later epoch, and if it is too late to see it, readers leave out all its versions from the later epoch's first on. States
lie in a few places per epoch that are written over in turn, so old versions go by themselves.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.registry import query
from lodestone.sources.sinks import folder
from lodestone.streaming.events import stream
from lodestone.streaming.queues import _DUE, LEASE, due
from lodestone.views import NOW, view

PLACES = 3
MOST = 1000  # rows of one request
MANIFEST = "version long, epoch int, source string, batch long, state string, grants string"
GRANTS = "worker long, request long, id long, until long"


class Fenced(RuntimeError):
    """Another writer has taken over."""


@dataclass
class Queue:
    spark: SparkSession
    target: str

    def _read(self, schema: str, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException:  # nothing there yet
            return self.spark.createDataFrame([], schema)

    def _append(self, row: tuple, schema: str, path: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)

    def manifest(self) -> DataFrame:
        """The versions that count: those with no version of a later epoch at or before them. One row a batch."""
        rows = self._read(MANIFEST, f"{self.target}/manifest")
        later = rows.groupBy("epoch").agg(F.min("version").alias("begin"))
        ahead = F.min("begin").over(Window.orderBy(F.desc("epoch")).rowsBetween(Window.unboundedPreceding, -1))  # one row an epoch
        begins = later.select("epoch", F.coalesce(ahead, F.lit(1 << 62)).alias("next"))
        return rows.join(F.broadcast(begins), "epoch").where("version < next").drop("next")

    def begin(self, state: DataFrame | None = None) -> int:
        """A new epoch; the first one stores the state."""
        epoch = (self._read("epoch int", f"{self.target}/epochs").agg(F.max("epoch")).first()[0] or 0) + 1
        self._append((epoch,), "epoch int", f"{self.target}/epochs")
        if state is not None and self.manifest().isEmpty():
            self.commit(epoch, "", -1, 0, state, None)
        return epoch

    def check(self, epoch: int) -> None:
        if (last := self._read("epoch int", f"{self.target}/epochs").agg(F.max("epoch")).first()[0]) != epoch:
            raise Fenced(f"epoch {epoch} was replaced by {last}")

    def commit(self, epoch: int, source: str, batch: int, version: int, state: DataFrame, grants: DataFrame | None) -> None:
        state.write.mode("overwrite").parquet(at := f"{self.target}/epoch-{epoch}/place-{version % PLACES}")
        given = ""
        if grants is not None:
            grants.write.parquet(given := f"{self.target}/grants/{version}-{epoch}-{uuid.uuid4().hex}")
        self.check(epoch)
        self._append((version, epoch, source, batch, at, given), MANIFEST, f"{self.target}/manifest")

    def state(self) -> DataFrame:
        return self.spark.read.parquet(self.manifest().orderBy(F.desc("version")).first()["state"])

    def grants(self) -> DataFrame:
        """worker, request, id, until of all claims that count; the manifest names their folders."""
        paths = [r.grants for r in self.manifest().where("grants <> ''").select("grants").collect()]
        return self.spark.read.schema(GRANTS).parquet(*paths) if paths else self.spark.createDataFrame([], GRANTS)

    def claim(self, epoch: int, source: str, batch: int, requests: DataFrame) -> bool:
        """Deals due rows to requests (request, worker, wanted); false if the batch was dealt before."""
        known = self.manifest()
        if not known.where((F.col("source") == source) & (F.col("batch") == batch)).isEmpty():
            return False
        self.check(epoch)
        last = known.orderBy(F.desc("version")).first()
        state = self.spark.read.parquet(last["state"])
        grants = dealt(state, requests)
        grants.write.parquet(at := folder(self.spark, "dealt"))
        grants = self.spark.read.schema(GRANTS).parquet(at)
        taken = state.join(grants.select("id", "until"), "id", "left")
        after = taken.withColumns({"extract_status": F.when(F.col("until").isNotNull(), "processing").otherwise(F.col("extract_status")), "next_retry_at": F.coalesce("until", "next_retry_at")}).select(state.columns)
        self.commit(epoch, source, batch, last["version"] + 1, after, grants)
        return True

    def run(self, requests: DataFrame, checkpoint: str, epoch: int) -> None:
        """Deals a stream of requests, each micro-batch once."""
        writer = requests.writeStream.foreachBatch(lambda batch, number: self.claim(epoch, checkpoint, number, batch) and None)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dealt(state: DataFrame, requests: DataFrame, now: int = NOW) -> DataFrame:
    """worker, request, id, until: the first due rows, dealt to the requests in their order, each as many as it wants.

    Only as many due rows are numbered as all requests want, MOST each at most.
    """
    wanted = requests.select("request", "worker", F.least("wanted", F.lit(MOST)).cast("long").alias("wanted")).where("wanted > 0")
    end = F.sum("wanted").over(Window.orderBy("request"))  # requests of one micro-batch
    slots = wanted.withColumn("end", end).select("request", "worker", F.explode(F.sequence(F.col("end") - F.col("wanted") + 1, F.col("end"))).alias("slot"))
    total = wanted.agg(F.coalesce(F.sum("wanted"), F.lit(0))).first()[0]
    rows = state.where(due("extract_status", now)).select("id").orderBy("id").limit(total)
    ranked = rows.withColumn("slot", F.row_number().over(Window.orderBy("id")).cast("long"))
    return slots.join(ranked, "slot").select(F.col("worker").cast("long"), F.col("request").cast("long"), "id", F.lit(now + LEASE).cast("long").alias("until"))


@query(f""", r AS (SELECT s_suppkey AS request, s_suppkey % 12 AS worker, s_suppkey % 4 AS wanted, sum(s_suppkey % 4) OVER (ORDER BY s_suppkey) AS e FROM supplier),
d AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM articles WHERE {_DUE.format(s='extract')})
SELECT worker, request, id, {NOW + LEASE} AS until FROM r JOIN d ON n > e - wanted AND n <= e""")
def claim_requests(spark, sf):
    """Rows that workers' stored requests get: each asks for up to three."""
    queue = Queue(spark, folder(spark, "queue"))
    epoch = queue.begin(view(spark, sf, "articles"))
    asked = stream_of(spark, sf)
    queue.run(asked, f"{queue.target}/checkpoint", epoch)
    return queue.grants()


def stream_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = stream(spark, sf, "supplier", ts=None)
    return rows.select(F.col("s_suppkey").alias("request"), (F.col("s_suppkey") % 12).alias("worker"), (F.col("s_suppkey") % 4).alias("wanted"))
