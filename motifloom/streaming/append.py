"""Snapshots as a stream: every micro-batch appends its snapshots and updates the motifs.

The state (open chains and motifs) is a table per version below ``home``.  A version counts once its
last table, ``done``, is there, so a batch that is run again after a failure either finds its version
done and changes nothing, or starts over from the version before.  A new process goes on from the
last version.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from motifloom.operators.mine import State, mine_prefix, update


@dataclass
class MotifStream:
    """Motifs of a growing graph.  ``cells`` of the stream: (edge_id, t, label), dense per snapshot.

    A batch may hold several snapshots, each whole.  Snapshots at or before the last one mined are
    refused with an error.
    """

    edges: DataFrame
    k: int
    delta: float
    c: int | None
    home: str
    labels: list[int] | None = None
    state: State | None = None
    done: set[int] = field(default_factory=set)

    def __post_init__(self):
        spark = self.edges.sparkSession
        try:
            versions = {r["version"]: r["t_end"] for r in spark.read.parquet(f"{self.home}/*/done").collect()}
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            versions = {}
        if versions:
            self.done = set(versions)
            self.state = self._read(max(versions), versions[max(versions)])

    def _read(self, version: int, t_end: int) -> State:
        spark = self.edges.sparkSession
        return State(t_end, spark.read.parquet(f"{self.home}/{version}/open"), spark.read.parquet(f"{self.home}/{version}/motifs"))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Take one batch; a batch id that was taken already changes nothing."""
        if batch_id in self.done:
            return
        batch = batch.select("edge_id", "t", "label")
        last = batch.agg({"t": "max"}).first()[0]
        if last is None:
            return
        if self.state is None:
            state = mine_prefix(batch, self.edges, self.k, self.delta, self.c, last, self.labels)
        else:
            state = update(self.state, batch, self.edges, self.k, self.delta, self.c, last, self.labels)
        place = f"{self.home}/{batch_id}"
        state.open_rows.write.mode("overwrite").parquet(f"{place}/open")
        state.members.write.mode("overwrite").parquet(f"{place}/motifs")
        self.edges.sparkSession.createDataFrame([(batch_id, last)], "version long, t_end int").coalesce(1).write.mode("overwrite").parquet(f"{place}/done")
        self.state = self._read(batch_id, last)
        self.done.add(batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a streaming DataFrame; the default trigger takes all that is there and stops."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    @property
    def motifs(self) -> DataFrame:
        """(s, e, comp, edge_id, label) of all motifs so far."""
        if self.state is None:
            raise ValueError("nothing has been appended")
        return self.state.members


def snapshots(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files of cells (edge_id, t, label)."""
    return spark.readStream.schema("edge_id long, t int, label int").option("maxFilesPerTrigger", files_per_batch).parquet(path)
