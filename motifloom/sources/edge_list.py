"""Temporal edge lists: reading, topology, dictionaries, deduplication, densifying.

Records are (u, v, t, w).  ``edges`` is (edge_id, u, v) and ``cells`` is (edge_id, t, label), one row
for every edge and snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifloom.sources.shared import stored

SCHEMA = "u long, v long, t int, w int"
DEFAULT_K = 10  # a fixed value: used when the file of thresholds is missing
ONE_TASK_IDS = 1_000_000  # above this, ids are numbered by ranges


def read_edge_list(spark: SparkSession, path: str, upto: int | None = None, after: int | None = None) -> DataFrame:
    """Records of a comma-separated file with ``after < t <= upto``; malformed lines fail."""
    records = spark.read.schema(SCHEMA).option("mode", "FAILFAST").csv(path)
    return limited(records, upto, after)


def limited(records: DataFrame, upto: int | None = None, after: int | None = None) -> DataFrame:
    """The snapshots in (after, upto]; plain predicates, so that a columnar scan gets them."""
    if upto is not None:
        records = records.filter(F.col("t") <= upto)
    if after is not None:
        records = records.filter(F.col("t") > after)
    return records


def read_numbers(spark: SparkSession, path: str, default: list[int] | None = None) -> list[int]:
    """One integer a line: thresholds or labels.  A missing or empty file gives ``default``."""
    try:
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").cast("int").alias("x")).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = []
    return [r["x"] for r in rows] or list(default if default is not None else [DEFAULT_K])


def with_ids(keys: DataFrame, *by: str) -> DataFrame:
    """``keys`` with ``edge_id``, their dense rank from 1 in the order of ``by`` (rows are distinct).

    A small set is ranked by one window.  A large one is sorted by ranges, numbered within each,
    and shifted by the sizes of the ranges before it.
    """
    if keys.count() <= ONE_TASK_IDS:
        return keys.withColumn("edge_id", F.row_number().over(Window.orderBy(*by)).cast("long"))
    spark = keys.sparkSession
    dealt = stored(keys.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())  # one row per range
    shifts, total = [], 0
    for part, n in sizes:
        shifts.append((part, total))
        total += n
    placed = dealt.join(F.broadcast(spark.createDataFrame(shifts, "__part int, __shift long")), "__part")
    return placed.withColumn("edge_id", F.row_number().over(Window.partitionBy("__part").orderBy(*by)) + F.col("__shift")).drop("__part", "__shift")


def topology(records: DataFrame) -> DataFrame:
    """(edge_id, u, v): the distinct undirected edges of the first snapshot."""
    first = records.agg(F.min("t").alias("t0"))
    ends = records.join(F.broadcast(first), F.col("t") == F.col("t0")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return with_ids(ends.distinct(), "u", "v").select("edge_id", "u", "v")


def dictionary(column: DataFrame) -> DataFrame:
    """(id, value): dense ids from 1 of one column's distinct values in ascending order."""
    name = column.columns[0]
    return with_ids(column.filter(F.col(name).isNotNull()).distinct(), name).select(F.col("edge_id").alias("id"), F.col(name).alias("value"))


def node_dictionary(records: DataFrame) -> DataFrame:
    return dictionary(records.select(F.col("u").alias("node")).unionAll(records.select("v")))


def label_dictionary(records: DataFrame) -> DataFrame:
    return dictionary(records.select("w"))


def label_cells(records: DataFrame, edges: DataFrame, order: Column | None = None) -> DataFrame:
    """(edge_id, t, label), one row for each edge and snapshot that occurs.

    Of several records the first by ``order`` counts (the smallest label, if none is given).
    Records of other edges than ``edges`` raise an error when the result is computed.
    """
    ends = records.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "t", "w", (order if order is not None else F.col("w")).alias("__order"))
    met = ends.join(edges, ["u", "v"], "left")
    known = met.withColumn("edge_id", F.when(F.col("edge_id").isNotNull(), F.col("edge_id")).otherwise(F.raise_error(F.lit("an edge is missing from the first snapshot")).cast("long")))
    return known.groupBy("edge_id", "t").agg(F.min_by("w", F.struct("__order", "w")).alias("label"))


def densify(cells: DataFrame, edges: DataFrame, first: int, last: int, fill: int = 0) -> DataFrame:
    """A row for every edge and snapshot of ``first`` to ``last``, ``fill`` where there was none."""
    grid = edges.select("edge_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("t"))
    return grid.join(cells, ["edge_id", "t"], "left").select("edge_id", "t", F.coalesce("label", F.lit(fill)).cast("int").alias("label"))


def spread(events: DataFrame, start: str, end: str, value: str, width: float) -> DataFrame:
    """Deal ``value`` of each record evenly over the snapshots of ``width`` that [start, end) overlaps.

    Adds ``t`` and replaces ``value`` by the snapshot's share; a record without length belongs to
    the snapshot that holds it.
    """
    low = F.floor(F.col(start) / width)
    high = F.greatest(low, F.ceil(F.col(end) / width) - 1)
    out = events.withColumn("t", F.explode(F.sequence(low, high)))
    overlap = F.least(F.col(end), (F.col("t") + 1) * width) - F.greatest(F.col(start), F.col("t") * width)
    length = F.col(end) - F.col(start)
    return out.withColumn(value, F.when(length > 0, F.col(value) * overlap / length).otherwise(F.col(value))).withColumn("t", F.col("t").cast("int"))


def virtual_share(cells: DataFrame, virtual: int = 0) -> DataFrame:
    """(edge_id, n_virtual, n_cells): how many snapshots of an edge have the virtual label."""
    return cells.groupBy("edge_id").agg(F.sum((F.col("label") == virtual).cast("long")).alias("n_virtual"), F.count("*").alias("n_cells"))


def drop_virtual(cells: DataFrame, virtual: int = 0, share: float = 0.5) -> DataFrame:
    """The cells of edges with less than ``share`` virtual labels."""
    kept = virtual_share(cells, virtual).filter(F.col("n_virtual") < share * F.col("n_cells")).select("edge_id")
    return cells.join(kept, "edge_id", "left_semi")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """Motifs of a level-3 text file: (s, e, edges array<struct<edge_id, label>>), labels null.

    A line ``startT: s<TAB>endT: e`` holds for the lines after it; ``E<n>`` announces a line of n ids.
    Order of lines matters, so each file is one text value.
    """
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^(?=startT:)")).alias("x"))
    cell = whole.filter(F.col("x").startswith("startT:")).select(
        F.regexp_extract("x", r"startT:\s*(\d+)", 1).cast("int").alias("s"), F.regexp_extract("x", r"endT:\s*(\d+)", 1).cast("int").alias("e"),
        F.explode(F.regexp_extract_all("x", F.lit(r"(?m)^E\d+[ \t]*\r?\n([\d, ]+)"), F.lit(1))).alias("ids"),
    )
    ids = F.transform(F.filter(F.split("ids", ","), lambda x: F.trim(x) != ""), lambda x: F.struct(F.trim(x).cast("long").alias("edge_id"), F.lit(None).cast("int").alias("label")))
    return cell.select("s", "e", F.array_sort(ids).alias("edges")).withColumn("size", F.size("edges")).withColumn("comp", F.col("edges")[0]["edge_id"])


# -- fixtures: graphs derived from ordinary tables ---------------------------------------------


def events_graph(events: DataFrame, first_day: str = "2024-01-01", days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(edges, cells): users and event types by day; label min(events of the day, 2)."""
    day = F.datediff(F.col("ts"), F.lit(first_day).cast("date")).cast("int")
    seen = events.select("user_id", "event_type", day.alias("t")).filter(F.col("user_id").isNotNull() & F.col("event_type").isNotNull() & F.col("t").between(0, days - 1))
    counts = seen.groupBy("user_id", "event_type", "t").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("label"))
    edges = with_ids(counts.select("user_id", "event_type").distinct(), "user_id", "event_type")
    cells = counts.join(edges, ["user_id", "event_type"]).select("edge_id", "t", "label")
    ends = edges.select("edge_id", F.concat(F.lit("u:"), F.col("user_id")).alias("u"), F.concat(F.lit("v:"), F.col("event_type")).alias("v"))
    return ends, densify(cells, edges, 0, days - 1)


def trade_graph(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, cells): supplier and customer nations by month from 1995; label by the quantity shipped."""
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    lines = lineitem.select("l_orderkey", "l_suppkey", "l_quantity", month.alias("t")).filter(F.col("t").between(0, 82))
    sold = (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("a")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("b")), F.col("o_custkey") == F.col("c_custkey"))
    )
    amounts = sold.groupBy("a", "b", "t").agg(F.sum("l_quantity").alias("q"))
    labelled = amounts.select("a", "b", "t", F.when(F.col("q") < 50, 1).when(F.col("q") < 200, 2).otherwise(3).alias("label"))
    edges = with_ids(labelled.select("a", "b").distinct(), "a", "b")
    cells = labelled.join(edges, ["a", "b"]).select("edge_id", "t", "label")
    ends = edges.select("edge_id", F.concat(F.lit("u:"), F.col("a")).alias("u"), F.concat(F.lit("v:"), F.col("b")).alias("v"))
    return ends, densify(cells, edges, 0, 82)
