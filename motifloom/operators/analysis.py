"""Comparison of motif sets: containment, coverage, and a validator.

A motif set is its members: (s, e, comp, edge_id[, label]).  "x inside y" means that every edge of x is
an edge of y and x's interval lies in y's.  Pairs are found through x's rarest edge in the other set,
then confirmed by counting the edges both have; both are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions.index import EPS, noise_fits, occurrences, relaxation
from motifloom.operators.maximal import KEY, larger_intervals

CASE_STUDY_EDGES = 50  # a fixed value: larger motifs are left out of the comparison with exact ones


def rarest_edges(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(s, e, comp, edge_id, n): of each inner motif the edge in the fewest outer motifs, and in how many."""
    often = outer.groupBy("edge_id").agg(F.count("*").alias("n"))
    ranked = inner.select(*KEY, "edge_id").join(often, "edge_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy(*KEY).agg(F.min(F.struct("n", "edge_id")).alias("x"))
    return best.select(*KEY, "x.edge_id", "x.n")


def inside(inner: DataFrame, outer: DataFrame, interval: Column | None = None) -> DataFrame:
    """(s, e, comp, size, s2, e2, comp2, size2): pairs of an inner motif and an outer one that holds its
    edges; ``interval`` is a condition on s, e, s2, e2 (default: s2 <= s and e <= e2)."""
    interval = (F.col("s2") <= F.col("s")) & (F.col("e") <= F.col("e2")) if interval is None else interval
    names = [F.col(c).alias(f"{c}2") for c in KEY]
    size, size2 = (m.groupBy(*KEY).agg(F.count("*").alias("size")) for m in (inner, outer))
    where = outer.select(*names, "edge_id")
    pairs = rarest_edges(inner, outer).filter("n > 0").join(where, "edge_id").filter(interval).select(*KEY, "s2", "e2", "comp2")
    pairs = pairs.join(size, KEY).join(size2.select(*names, F.col("size").alias("size2")), ["s2", "e2", "comp2"]).filter("size2 >= size")
    both = pairs.join(inner.select(*KEY, "edge_id"), KEY).join(where, ["s2", "e2", "comp2", "edge_id"], "left_semi")
    held = both.groupBy(*KEY, "size", "s2", "e2", "comp2", "size2").agg(F.count("*").alias("n"))
    return held.filter("n = size").drop("n")


def small(members: DataFrame, most: int | None) -> DataFrame:
    """The motifs of at most ``most`` edges."""
    if most is None:
        return members
    return members.join(members.groupBy(*KEY).agg(F.count("*").alias("size")).filter(F.col("size") <= most).select(*KEY), KEY, "left_semi")


def compare(original: DataFrame, relaxed: DataFrame, most_edges: int | None = CASE_STUDY_EDGES) -> DataFrame:
    """(s, e, comp, contained, contained_all): for each relaxed motif the intervals that hold an original
    motif inside it (one counts per interval), and all original motifs inside it."""
    outer, inner = small(relaxed, most_edges), small(original, most_edges)
    pairs = inside(inner, outer)
    counts = pairs.groupBy("s2", "e2", "comp2").agg(F.countDistinct("s", "e").alias("contained"), F.count("*").alias("contained_all"))
    motifs = outer.select(*KEY).distinct()
    named = counts.select(F.col("s2").alias("s"), F.col("e2").alias("e"), F.col("comp2").alias("comp"), "contained", "contained_all")
    return motifs.join(named, KEY, "left").select(*KEY, F.coalesce("contained", F.lit(0)).alias("contained"), F.coalesce("contained_all", F.lit(0)).alias("contained_all"))


def comparison_summary(compared: DataFrame, original: DataFrame, relaxed: DataFrame) -> DataFrame:
    """One row: totals, motifs that contain at least one or exactly one original, and the ratios."""
    totals = original.select(*KEY).distinct().agg(F.count("*").alias("originals")).join(relaxed.select(*KEY).distinct().agg(F.count("*").alias("relaxed")))
    c = F.col("contained")
    found = compared.agg(F.count(F.when(c > 0, 1)).alias("containing"), F.count(F.when(c == 1, 1)).alias("containing_one"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("contained"))
    ratio = lambda a, b: (F.col(a) / F.nullif(F.col(b), F.lit(0)))
    return found.join(totals).select("*", ratio("containing", "relaxed").alias("containing_share"), ratio("containing_one", "relaxed").alias("one_share"), ratio("contained", "relaxed").alias("mean_contained"), ratio("contained", "originals").alias("contained_share"))


def self_containment(members: DataFrame, k: int, delta: float) -> DataFrame:
    """(s, e, comp, contained): intervals strictly inside a motif's, longer than the noise it may
    hold (its length * delta / (1 - delta)), with a motif of its edges.  Motifs for which that
    noise is under k are not looked at."""
    gap = (F.col("e2") - F.col("s2") + 1) * F.lit(delta) / F.lit(1 - delta)
    # within an inner interval [s, e] of the motif [s2, e2]: s2 < s <= e2 - k and e < e2
    fits = (F.col("s") > F.col("s2")) & (F.col("e") < F.col("e2")) & (F.col("s") <= F.col("e2") - k) & (F.col("e") - F.col("s") + 1 - gap > -EPS) & ~((F.col("e") - F.col("s") + 1 - gap) < EPS)
    enough = (F.col("e") - F.col("s") + 1) * F.lit(delta) / F.lit(1 - delta) - k >= -EPS
    outer = members.filter(enough)
    counts = inside(members, outer, fits).groupBy("s2", "e2", "comp2").agg(F.countDistinct("s", "e").alias("contained"))
    named = counts.select(F.col("s2").alias("s"), F.col("e2").alias("e"), F.col("comp2").alias("comp"), "contained")
    return outer.select(*KEY).distinct().join(named, KEY, "left").select(*KEY, F.coalesce("contained", F.lit(0)).alias("contained"))


def coverage(original: DataFrame, relaxed: DataFrame) -> DataFrame:
    """One row: original motifs inside some relaxed motif and all, relaxed motifs that hold one and all,
    and how often both are the same."""
    pairs = inside(original, relaxed)
    found = pairs.agg(
        F.countDistinct("s", "e", "comp").alias("covered"), F.countDistinct("s2", "e2", "comp2").alias("covering"),
        F.count(F.when((F.col("s") == F.col("s2")) & (F.col("e") == F.col("e2")) & (F.col("size") == F.col("size2")), 1)).alias("same"),
    )
    totals = original.select(*KEY).distinct().agg(F.count("*").alias("originals")).join(relaxed.select(*KEY).distinct().agg(F.count("*").alias("relaxed")))
    return found.join(totals).select("covered", "originals", "covering", "relaxed", "same")


def validate(members: DataFrame, cells: DataFrame, ei: DataFrame, k: int, delta: float, c: int | None) -> DataFrame:
    """(s, e, comp, problem): motifs that break a rule, from the cells themselves; none are expected.

    ``ends``: an edge has another label at an end than its main label; ``block``: it is without it
    for over c snapshots in a row; ``noise``: for over delta of all; ``short``: under k snapshots;
    ``larger``: a larger interval (on either or both sides) holds the motif.
    """
    delta, c = relaxation(delta, c)
    # the index rows at both ends: one chain has no gap of over c, and mismatches are a difference
    at = occurrences(cells, c).select("edge_id", "label", "t", "dif", "chain")
    first, last = at.toDF("edge_id", "label", "s", "dif", "chain"), at.toDF("edge_id", "label", "e", "dif2", "chain2")
    met = members.join(first, ["edge_id", "label", "s"], "left").join(last, ["edge_id", "label", "e"], "left")
    length = F.col("e") - F.col("s") + 1
    bad = met.select(
        *KEY,
        F.when(length < k, "short")
        .when(F.col("chain").isNull() | F.col("chain2").isNull(), "ends")
        .when(F.col("chain") != F.col("chain2"), "block")
        .when(~noise_fits(F.col("dif2") - F.col("dif"), length, delta), "noise")
        .alias("problem"),
    ).filter("problem is not null")
    larger = larger_intervals(members, ei).select(*KEY, F.lit("larger").alias("problem"))
    return bad.unionByName(larger).distinct()
