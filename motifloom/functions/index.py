"""The index of a temporal graph: runs, mismatch counts and chains as window columns.

All windows are over one edge or one label of one edge, so after one exchange by ``edge_id`` nothing
is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-7  # a fixed value: the tolerance of the noise test


def _along_label() -> WindowSpec:
    return Window.partitionBy("edge_id", "label").orderBy("t")


def relaxation(delta: float, c: int | None) -> tuple[float, int | None]:
    """Exact matching if either bound is 0; ``c`` None is unlimited."""
    if delta < 0 or (c is not None and c < 0):
        raise ValueError("delta and c must not be negative")
    return (0.0, 0) if delta == 0 or c == 0 else (delta, c)


def noise_fits(noise: Column, length: Column, delta: float) -> Column:
    return noise - F.lit(float(delta)) * length <= EPS


def occurrences(cells: DataFrame, c: int | None) -> DataFrame:
    """``cells`` with ``dif`` (snapshots up to t that do not have t's label) and ``chain`` (grows where
    the label was away for over ``c`` snapshots)."""
    rows = cells.repartition("edge_id")
    first = F.min("t").over(Window.partitionBy("edge_id"))
    dif = F.col("t") - first + 1 - F.row_number().over(_along_label())
    broken = F.when(F.col("t") - F.lag("t").over(_along_label()) - 1 > (c if c is not None else 2**31 - 2), 1).otherwise(0)
    rows = rows.withColumn("dif", dif.cast("int")).withColumn("__broken", broken)
    return rows.withColumn("chain", F.sum("__broken").over(_along_label()).cast("int")).drop("__broken")


def runs(cells: DataFrame) -> DataFrame:
    """``cells`` with ``run_start`` and ``run_end`` of the block of equal labels that holds each."""
    rows = cells.repartition("edge_id").withColumn("__run", F.col("t") - F.row_number().over(_along_label()))
    run = Window.partitionBy("edge_id", "label", "__run")
    return rows.withColumn("run_start", F.min("t").over(run)).withColumn("run_end", F.max("t").over(run)).drop("__run")


def run_bounds(cells: DataFrame) -> DataFrame:
    """(edge_id, t, label, bef, aft): run length up to and from each cell."""
    return runs(cells).select("edge_id", "t", "label", (F.col("t") - F.col("run_start") + 1).alias("bef"), (F.col("run_end") - F.col("t") + 1).alias("aft"))


def run_table(cells: DataFrame) -> DataFrame:
    """(edge_id, label, run_start, run_end): one row per run."""
    return runs(cells).filter("t = run_start").select("edge_id", "label", "run_start", "run_end")


def run_links(cells: DataFrame) -> DataFrame:
    """Runs with the end of the previous and the start of the next run of the same label."""
    along = Window.partitionBy("edge_id", "label").orderBy("run_start")
    return run_table(cells).withColumn("prev_end", F.lag("run_end").over(along)).withColumn("next_start", F.lead("run_start").over(along))


def tails(cells: DataFrame) -> DataFrame:
    """(edge_id, label, tail): the last snapshot of each label of each edge."""
    return cells.groupBy("edge_id", "label").agg(F.max("t").alias("tail"))


def run_stats(cells: DataFrame) -> DataFrame:
    """One row: the most runs of an edge, and their mean number."""
    return run_table(cells).groupBy("edge_id").count().agg(F.max("count").alias("max_runs"), F.avg("count").alias("avg_runs"))


def label_at(cells: DataFrame, places: DataFrame) -> DataFrame:
    """``places(edge_id, t, ...)`` with the label there."""
    return places.join(cells, ["edge_id", "t"])


def same_label(cells: DataFrame, t1: int, t2: int) -> DataFrame:
    """(edge_id, same): whether each edge has one label at both snapshots."""
    two = cells.filter(F.col("t").isin(t1, t2)).groupBy("edge_id")
    return two.agg((F.max(F.when(F.col("t") == t1, F.col("label"))) == F.max(F.when(F.col("t") == t2, F.col("label")))).alias("same"))


def same_labels_of_sets(cells: DataFrame, sets: DataFrame, t1: int, t2: int) -> DataFrame:
    """(set_id, same): whether all edges of each set of ``sets(set_id, edge_id)`` keep their label."""
    return sets.join(same_label(cells, t1, t2), "edge_id").groupBy("set_id").agg(F.bool_and("same").alias("same"))


def summary(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: numbers of nodes, edges, snapshots and labels."""
    nodes = edges.select(F.col("u").alias("n")).unionAll(edges.select("v")).agg(F.countDistinct("n").alias("nodes"))
    rest = cells.agg(F.countDistinct("edge_id").alias("edges"), F.countDistinct("t").alias("snapshots"), F.countDistinct("label").alias("labels"))
    return nodes.join(rest)
