"""Maximality: a component is a motif if no larger interval holds all its edges with their labels.

All members valid on one larger interval are connected there, so containment in a component of that
interval is the same as every member having a row for it in the relation of valid intervals.  The
candidates for larger intervals are those of the member with the fewest valid intervals, within the
scope of the component: no member can leave the stretch of snapshots that its own valid intervals
cover without a gap.  Components that fill their scope are settled there.  Every further step is an
equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["s", "e", "comp"]


def covered(ei: DataFrame) -> DataFrame:
    """(edge_id, label, n, stretches): number of valid intervals, and the stretches (lo, hi) of
    snapshots that they cover; overlapping intervals are one stretch."""
    reach = ei.repartition("edge_id", "label").groupBy("edge_id", "label", "s").agg(F.max("e").alias("e"), F.count("*").alias("n"))
    along = Window.partitionBy("edge_id", "label").orderBy("s")
    before = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = reach.withColumn("begins", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).withColumn("stretch", F.sum("begins").over(along))
    one = marked.groupBy("edge_id", "label", "stretch").agg(F.min("s").alias("lo"), F.max("e").alias("hi"), F.sum("n").alias("n"))
    return one.groupBy("edge_id", "label").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lo", "hi")).alias("stretches"))


def scopes(members: DataFrame, ei: DataFrame) -> DataFrame:
    """(s, e, comp, size, lo, hi, r): between which snapshots a component could grow, and its member with the
    fewest valid intervals, struct (n, edge_id, label).  Components with a member whose interval lies in
    no stretch are left out: nothing in ``ei`` is larger."""
    met = members.join(covered(ei), ["edge_id", "label"], "left")
    # stretches that hold the interval: one at most
    own = F.get(F.filter("stretches", lambda x: (x["lo"] <= F.col("s")) & (x["hi"] >= F.col("e"))), F.lit(0))
    return met.withColumn("own", own).groupBy(*KEY).agg(
        F.count("*").alias("size"), F.count("own").alias("held"), F.max("own.lo").alias("lo"), F.min("own.hi").alias("hi"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "edge_id", "label")).alias("r")
    ).filter("held = size").drop("held")


def larger_intervals(members: DataFrame, ei: DataFrame) -> DataFrame:
    """(s, e, comp, size, s2, e2): strictly larger intervals on which all members of a component are
    valid with the same labels.  members: (s, e, comp, edge_id, label)."""
    rare = scopes(members, ei).filter("lo < s or hi > e")
    wide = ei.select(F.col("edge_id").alias("edge"), F.col("label").alias("main"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    candidates = rare.select(*KEY, "size", "lo", "hi", F.col("r.edge_id").alias("edge"), F.col("r.label").alias("main")).join(wide, ["edge", "main"])
    candidates = candidates.filter("s2 <= s and e2 >= e and (s2 < s or e2 > e) and s2 >= lo and e2 <= hi").select(*KEY, "size", "s2", "e2")
    asked = candidates.join(members, KEY)
    there = ei.select("edge_id", "label", F.col("s").alias("s2"), F.col("e").alias("e2"))
    held = asked.join(there, ["edge_id", "label", "s2", "e2"], "left_semi")
    return held.groupBy(*KEY, "size", "s2", "e2").agg(F.count("*").alias("n")).filter("n = size").drop("n")


def expandable(members: DataFrame, ei: DataFrame) -> DataFrame:
    """(s, e, comp) of the components that some larger interval holds."""
    return larger_intervals(members, ei).select(*KEY).distinct()


def maximal_members(members: DataFrame, ei: DataFrame) -> DataFrame:
    """The members of the components that are motifs."""
    return members.join(expandable(members, ei), KEY, "left_anti")


def maximal_exact(members: DataFrame, run_ends: DataFrame) -> DataFrame:
    """For exact matching: the latest run start must be s and the earliest run end e.
    run_ends: (edge_id, s, run_start, max_e) of exact_filter."""
    bounds = members.join(run_ends.select("edge_id", "s", "run_start", "max_e"), ["edge_id", "s"])
    kept = bounds.groupBy(*KEY).agg(F.max("run_start").alias("lo"), F.min("max_e").alias("hi")).filter("lo = s and hi = e").select(*KEY)
    return members.join(kept, KEY, "left_semi")
