"""Valid intervals of edges: the relation everything else is built from.

(edge_id, label, s, e, noise): on [s, e] the edge has ``label`` at both ends, is without it for at
most c snapshots in a row and for at most delta of all, and the interval has k snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions.index import EPS, noise_fits, occurrences, relaxation, runs


def valid_intervals(cells: DataFrame, k: int, delta: float, c: int | None, labels: list[int] | None = None) -> DataFrame:
    """All valid intervals of all edges; ``labels`` keeps only those main labels.

    Within a chain the bound c holds by construction, so pairs of one chain's occurrences
    are enumerated in place, without a join: arrays are as long as a label's chain.
    """
    delta, c = relaxation(delta, c)
    rows = cells if labels is None else cells.withColumn("__keep", F.col("label").isin(labels))
    rows = occurrences(rows, c)
    if labels is not None:
        rows = rows.filter("__keep")
    return pairs_of_chains(rows, k, delta)


def pairs_of_chains(rows: DataFrame, k: int, delta: float) -> DataFrame:
    """Valid intervals of rows (edge_id, label, chain, t, dif)."""
    chains = rows.groupBy("edge_id", "label", "chain").agg(F.array_sort(F.collect_list(F.struct("t", "dif"))).alias("a"))

    def ends(x: Column, i: Column) -> Column:
        later = F.slice("a", i + 1, F.size("a"))
        fits = lambda y: (y["t"] - x["t"] + 1 >= k) & noise_fits(y["dif"] - x["dif"], y["t"] - x["t"] + 1, delta)
        return F.transform(F.filter(later, fits), lambda y: F.struct(x["t"].alias("s"), y["t"].alias("e"), (y["dif"] - x["dif"]).alias("noise")))

    return chains.select("edge_id", "label", F.inline(F.flatten(F.transform("a", ends))))


def valid_ranges(cells: DataFrame, k: int, delta: float, c: int | None) -> DataFrame:
    """(edge_id, label, s, lo, hi): the valid ends of each start as maximal closed ranges.

    A row per start and later run instead of one per start and end: within a run mismatches no
    longer grow, so its valid ends are those from the first admissible one on, which is found by
    arithmetic.
    """
    delta, c = relaxation(delta, c)
    run = occurrences(cells, c).groupBy("edge_id", "label", "chain", "dif").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    chains = run.groupBy("edge_id", "label", "chain").agg(F.array_sort(F.collect_list(F.struct("a", "b", "dif"))).alias("r"))
    starts = chains.select("edge_id", "label", "r", F.posexplode("r").alias("i", "own")).select("edge_id", "label", "r", "i", "own.dif", F.explode(F.sequence("own.a", "own.b")).alias("s"))

    def part(x: Column) -> Column:
        noise = x["dif"] - F.col("dif")
        if delta == 0:
            first = F.when(noise == 0, F.col("s")).otherwise(x["b"] + 1)
        else:
            first = F.col("s") - 1 + F.ceil((noise - EPS) / F.lit(float(delta))).cast("int")
        return F.struct(F.greatest(x["a"], F.col("s") + k - 1, first).alias("lo"), x["b"].alias("hi"))

    ranges = F.filter(F.transform(F.slice("r", F.col("i") + 1, F.size("r")), part), lambda x: x["lo"] <= x["hi"])
    return starts.select("edge_id", "label", "s", F.inline(ranges))


def exact_filter(cells: DataFrame, k: int) -> DataFrame:
    """(edge_id, label, s, run_start, max_e): edges constant on [s, s + k - 1], with their run."""
    return runs(cells).filter(F.col("run_end") - F.col("t") + 1 >= k).select("edge_id", "label", F.col("t").alias("s"), "run_start", F.col("run_end").alias("max_e"))


def short_intervals(cells: DataFrame, k: int, delta: float) -> DataFrame:
    """Valid intervals too short for a mismatch (delta * length < 1): by run lengths alone."""
    longest = _short(delta)
    rows = exact_filter(cells, k).withColumn("max_e", F.least("max_e", F.col("s") + longest - 1) if longest is not None else F.col("max_e"))
    rows = rows.filter(F.col("max_e") - F.col("s") + 1 >= k)
    return rows.select("edge_id", "label", "s", F.explode(F.sequence(F.col("s") + k - 1, F.col("max_e"))).alias("e"), F.lit(0).alias("noise"))


def _short(delta: float) -> int | None:
    """The greatest length without room for a mismatch; None if every length is."""
    if delta == 0:
        return None
    n = int(1 / delta)
    while n and delta * n - 1 >= -1e-7:
        n -= 1
    return n


def valid_intervals_split(cells: DataFrame, k: int, delta: float, c: int | None) -> DataFrame:
    """The same relation as valid_intervals, short intervals taken from runs and only longer ones from chains."""
    delta, c = relaxation(delta, c)
    longest = _short(delta)
    short = short_intervals(cells, k, delta)
    if longest is None:
        return short
    return short.unionByName(valid_intervals(cells, max(k, longest + 1), delta, c))


def rset(ei: DataFrame) -> DataFrame:
    """(s, edge_id, label, max_e): for each start the edges that are valid from it, and up to where."""
    return ei.groupBy("s", "edge_id", "label").agg(F.max("e").alias("max_e"))


def exact_rset(cells: DataFrame, k: int) -> DataFrame:
    return exact_filter(cells, k).select("s", "edge_id", "label", "max_e")


def tabu_ends(ei: DataFrame, k: int) -> DataFrame:
    """(edge_id, label, s, e): ends between s + k - 1 and the last valid end that are not valid."""
    ends = ei.groupBy("edge_id", "label", "s").agg(F.collect_set("e").alias("ok"), F.max("e").alias("max_e"))
    return ends.select("edge_id", "label", "s", F.explode(F.array_except(F.sequence(F.col("s") + k - 1, F.col("max_e")), "ok")).alias("e"))


def tabu_ranges(ei: DataFrame, k: int) -> DataFrame:
    """(edge_id, label, s, lo, hi): the same as maximal closed ranges."""
    ends = ei.groupBy("edge_id", "label", "s").agg(F.array_sort(F.collect_set("e")).alias("ok"))
    bounds = F.concat(F.array(F.col("s") + k - 2), F.col("ok"))
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size("ok")), lambda i: F.struct((F.element_at(bounds, i) + 1).alias("lo"), (F.element_at(bounds, i + 1) - 1).alias("hi"))), lambda g: g["lo"] <= g["hi"])
    return ends.select("edge_id", "label", "s", F.inline(gaps))


def selection_stats(ei: DataFrame, k: int) -> DataFrame:
    """One row: the largest and the (whole) mean number of edges valid on [s, s + k - 1]."""
    rows = ei.filter(F.col("e") - F.col("s") + 1 == k).groupBy("s").count()
    return rows.agg(F.max("count").alias("max_sm"), F.floor(F.avg("count")).alias("aver_sm"))


def row_common_edges(ei: DataFrame, k: int) -> DataFrame:
    """(s, n_common, n_new): edges valid from s that also were from s - 1, and those that came in."""
    rows = rset(ei).select("s", "edge_id").distinct()
    before = rows.select((F.col("s") + 1).alias("s"), "edge_id", F.lit(1).alias("was"))
    return rows.join(before, ["s", "edge_id"], "left").groupBy("s").agg(F.count("was").alias("n_common"), (F.count("*") - F.count("was")).alias("n_new"))


def current_noise(cells: DataFrame, c: int | None, at: int) -> DataFrame:
    """(edge_id, label, local, chain_noise): for chains open at ``at``, snapshots since the label was
    last seen, and mismatches inside the chain so far."""
    rows = occurrences(cells.filter(F.col("t") <= at), c)
    last = rows.groupBy("edge_id", "label", "chain").agg(F.max("t").alias("last_t"), F.min("t").alias("first_t"), F.max("dif").alias("hi"), F.min("dif").alias("lo"))
    last = last.filter(F.lit(at) - F.col("last_t") <= (c if c is not None else 2**31 - 2))
    return last.select("edge_id", "label", (F.lit(at) - F.col("last_t")).alias("local"), (F.col("hi") - F.col("lo")).alias("chain_noise"))


def last_interval(ei: DataFrame, label: int) -> DataFrame:
    """(edge_id, s, e): each edge's latest valid interval with the given label."""
    return ei.filter(F.col("label") == label).groupBy("edge_id").agg(F.max(F.struct("e", "s")).alias("x")).select("edge_id", "x.s", "x.e")


def overlapping(intervals: DataFrame, t: int) -> DataFrame:
    """Intervals that reach ``t`` or later."""
    return intervals.filter(F.col("e") >= t)
