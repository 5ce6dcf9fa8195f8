"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from motifloom.llm._shared import stored

HOT_ROWS = 1000


def _with_low(rows: DataFrame, low: DataFrame, limit: int | None) -> DataFrame:
    """``rows(a, b)`` with m of ``low(a, m, n)``, where n counts the rows of a.

    Nodes with over ``limit`` rows are so few that their m is broadcast; their rows stay where they are.
    Without a limit no node is such: a broadcast, even of nothing, costs the driver memory.
    """
    if limit is None:
        return rows.join(low.select("a", "m"), "a")
    hot = low.filter(F.col("n") > limit).select("a", F.col("m").alias("hot_m"))
    met = rows.join(F.broadcast(hot), "a", "left")
    others = met.filter("hot_m is null").select("a", "b").join(low.select("a", "m"), "a")
    return met.filter("hot_m is not null").select("a", "b", F.col("hot_m").alias("m")).unionAll(others.select("a", "b", "m"))


def _extent(e: DataFrame) -> Row:
    """Of ``e(a, b)``: the number of edges, the most that one node has, and two sums over all edges."""
    ends = e.select("a", F.xxhash64("a", "b").alias("h")).unionAll(e.select("b", F.lit(None).cast("long")))
    each = ends.groupBy("a").agg(F.count("h").alias("n"), F.count("*").alias("all"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return each.agg(F.sum("n").alias("edges"), F.max("all").alias("most"), F.bit_xor("x"), F.sum("s")).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Large-star and small-star steps alternate until the edges are stars.  Every step is an
    aggregate with map-side sums and a join; the rows of a node with over a thousandth of them, so of
    under a thousand nodes, are joined in place.  A round's result is a table in the shared folder.
    Loops and null ends are ignored.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = _extent(e)
    for _ in range(max_rounds):
        if not now["edges"]:
            break
        limit = max(HOT_ROWS, 2 * now["edges"] // 1000)
        # a node has no more rows in the small-star step than it had in the large-star step
        limit = limit if now["most"] > limit else None
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        e = _with_low(both, low, limit).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        met = _with_low(e, low, limit)
        e = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(e, "edges")
        before, now = now, _extent(e)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select("b", "b").distinct().toDF("node", "root"))
