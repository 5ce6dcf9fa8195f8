"""Connected components of the edges that are valid on each interval.

Where the graph's edge count is at most CELL_EDGES, one interval's edges fit a task: rows are dealt and
sorted by interval and a union-find runs over each interval's rows as they stream by.  Larger graphs
use label stars over (interval, node), which never hold a component in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.sources.shared import stored

CELL_EDGES = 4_000_000
MEMBERS = "s int, e int, comp long, edge_id long, label int"
_MEMBERS = pa.schema([("s", pa.int32()), ("e", pa.int32()), ("comp", pa.int64()), ("edge_id", pa.int64()), ("label", pa.int32())])


def _roots(u: list, v: list) -> dict:
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(u, v, strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
    return {x: find(x) for x in parent}


def _cell(s: int, e: int, ids: list, labels: list, u: list, v: list) -> pa.RecordBatch:
    roots = _roots(u, v)
    smallest: dict = {}
    for x, i in zip(u, ids, strict=True):
        r = roots[x]
        if r not in smallest or i < smallest[r]:
            smallest[r] = i
    return pa.RecordBatch.from_arrays([pa.array([s] * len(ids), pa.int32()), pa.array([e] * len(ids), pa.int32()), pa.array([smallest[roots[x]] for x in u], pa.int64()), pa.array(ids, pa.int64()), pa.array(labels, pa.int32())], schema=_MEMBERS)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (s, e): one interval in memory at a time."""
    now, held = None, ([], [], [], [])
    for b in batches:
        for s, e, *row in zip(*(b.column(c).to_pylist() for c in ("s", "e", "edge_id", "label", "u", "v")), strict=True):
            if (s, e) != now:
                if now is not None:
                    yield _cell(*now, *held)
                now, held = (s, e), ([], [], [], [])
            for x, y in zip(held, row, strict=True):
                x.append(y)
    if now is not None:
        yield _cell(*now, *held)


def component_members(ei: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, e, comp, edge_id, label): every valid interval's row with its component, which is named by
    its smallest edge id."""
    rows = ei.select("s", "e", "edge_id", "label").join(edges.select("edge_id", "u", "v"), "edge_id")
    if edges.count() > CELL_EDGES:
        return component_members_by_stars(rows)
    return rows.repartition("s", "e").sortWithinPartitions("s", "e").mapInArrow(_walk, MEMBERS)


def component_members_by_stars(rows: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The same for rows (s, e, edge_id, label, u, v) of any size: large-star and small-star rounds
    over (s, e, node) until nothing changes."""
    cell = ["s", "e"]
    rows = stored(rows, "cell-edges")
    links = rows.filter("u <> v").select(*cell, F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    before = None
    for _ in range(max_rounds):
        both = links.unionAll(links.select(*cell, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*cell, "a").agg(F.min("b").alias("m")).select(*cell, "a", F.least("a", "m").alias("m"))
        links = both.join(low, [*cell, "a"]).filter("b > a").select(*cell, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = links.groupBy(*cell, "a").agg(F.min("b").alias("m"))
        links = links.join(low, [*cell, "a"]).filter("b <> m").select(*cell, F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(*cell, "a", F.col("m").alias("b"))).distinct()
        links = stored(links, "cell-links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64(*cell, "a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = rows.join(links.select(*cell, F.col("a").alias("u"), F.col("b").alias("root")), [*cell, "u"], "left").withColumn("root", F.coalesce("root", "u"))
    least = named.groupBy(*cell, "root").agg(F.min("edge_id").alias("comp"))
    return named.join(least, [*cell, "root"]).select("s", "e", "comp", "edge_id", "label")


def components(members: DataFrame) -> DataFrame:
    """(s, e, comp, size, edges): one row per component, edges as a sorted array of (edge_id, label)."""
    return members.groupBy("s", "e", "comp").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("edge_id", "label"))).alias("edges"))
