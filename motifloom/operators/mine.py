"""Mining: relaxed and exact motifs, for one threshold or several, whole or incrementally."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions.index import occurrences, relaxation
from motifloom.operators.connectivity import component_members, components
from motifloom.operators.intervals import exact_filter, pairs_of_chains, valid_intervals, valid_intervals_split
from motifloom.operators.maximal import expandable, maximal_exact, maximal_members
from motifloom.sources.edge_list import limited
from motifloom.sources.shared import stored

# fixed values: the numbers by which users call the algorithms.  All give the same motifs; "plus" takes
# short intervals from runs.  Those of the second line keep state for updates, those of the third update.
ALGORITHMS = {
    12: "plain", 22: "plain", 31: "plus",
    20: "plain", 23: "plain", 33: "plus",
    19: "plain", 24: "plain", 34: "plus",
}


def plan_of(algorithm: str | int) -> str:
    """"plain" or "plus", given as such or by number."""
    name = ALGORITHMS.get(algorithm) if isinstance(algorithm, int) else algorithm
    if name not in ("plain", "plus"):
        raise ValueError(f"no algorithm {algorithm!r}")
    return name


def motif_members(cells: DataFrame, edges: DataFrame, k: int, delta: float, c: int | None, labels: list[int] | None = None, t_end: int | None = None, algorithm: str | int = "plain") -> DataFrame:
    """(s, e, comp, edge_id, label): the edges of every motif."""
    if k < 1:
        raise ValueError("k must be at least 1")
    delta, c = relaxation(delta, c)
    cells = limited(cells, t_end)
    plus = plan_of(algorithm) == "plus" and labels is None
    ei = stored((valid_intervals_split if plus else valid_intervals)(cells, k, delta, c, **({} if plus else {"labels": labels})), "intervals")
    members = stored(component_members(ei, edges), "members")
    if delta == 0:
        return maximal_exact(members, exact_filter(cells, k))
    return maximal_members(members, ei)


def mine(cells: DataFrame, edges: DataFrame, k: int, delta: float, c: int | None, labels: list[int] | None = None, t_end: int | None = None, algorithm: str | int = "plain") -> DataFrame:
    """Motifs (s, e, comp, size, edges array<struct<edge_id, label>>)."""
    return components(motif_members(cells, edges, k, delta, c, labels, t_end, algorithm))


def mine_many(cells: DataFrame, edges: DataFrame, ks: list[int], delta: float, c: int | None, **more) -> DataFrame:
    """Motifs for several thresholds, with a column ``k``.

    A threshold only bounds the length: what is valid, connected and maximal on an interval does
    not depend on it.  So the smallest is mined, and the others keep its longer motifs.
    """
    if not ks:
        raise ValueError("no threshold is given")
    found = mine(cells, edges, min(ks), delta, c, **more)
    each = found.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return each.filter(F.col("e") - F.col("s") + 1 >= F.col("k"))


def open_chains(cells: DataFrame, c: int | None, at: int) -> DataFrame:
    """Occurrence rows (edge_id, label, t) up to ``at`` of the chains that snapshots after it can continue."""
    rows = occurrences(limited(cells, at), c).select("edge_id", "label", "chain", "t")
    last = rows.groupBy("edge_id", "label", "chain").agg(F.max("t").alias("last_t")).filter(F.lit(at) - F.col("last_t") <= (c if c is not None else 2**31 - 2))
    return rows.join(last.select("edge_id", "label", "chain"), ["edge_id", "label", "chain"], "left_semi").select("edge_id", "label", "t")


@dataclass
class State:
    """What a later update needs: the last snapshot, the open chains and the motifs so far."""

    t_end: int
    open_rows: DataFrame
    members: DataFrame


def mine_prefix(cells: DataFrame, edges: DataFrame, k: int, delta: float, c: int | None, t_end: int, labels: list[int] | None = None, algorithm: str | int = "plain") -> State:
    """Mine the snapshots up to ``t_end`` and keep the state for updates."""
    d, cc = relaxation(delta, c)
    return State(t_end, stored(open_chains(cells, cc, t_end), "open"), stored(motif_members(cells, edges, k, d, cc, labels, t_end, algorithm), "motifs"))


def delta_intervals(open_rows: DataFrame, delta_cells: DataFrame, k: int, delta: float, c: int | None, after: int, labels: list[int] | None = None, algorithm: str | int = "plain") -> DataFrame:
    """Valid intervals that end after ``after``, from open chains and the new snapshots alone.

    "plus" takes intervals too short for a mismatch from the runs of these rows: a run that reaches
    into the new snapshots lies whole in an open chain."""
    delta, c = relaxation(delta, c)
    rows = open_rows.unionByName(delta_cells.select("edge_id", "label", "t"))
    if labels is not None:
        rows = rows.filter(F.col("label").isin(labels))
    if plan_of(algorithm) == "plus":
        return valid_intervals_split(rows, k, delta, c).filter(F.col("e") > after)
    # mismatches between two occurrences need only the occurrences between them
    return pairs_of_chains(occurrences(rows, c), k, delta).filter(F.col("e") > after)


def update_parts(state: State, delta_cells: DataFrame, edges: DataFrame, k: int, delta: float, c: int | None, labels: list[int] | None = None, algorithm: str | int = "plain") -> tuple[DataFrame, DataFrame]:
    """(retired, added): keys of old motifs that can now be expanded, and members of new motifs."""
    ei = stored(delta_intervals(state.open_rows, delta_cells, k, delta, c, state.t_end, labels, algorithm), "delta-intervals")
    members = stored(component_members(ei, edges), "delta-members")
    return expandable(state.members, ei), maximal_members(members, ei)


def update(state: State, delta_cells: DataFrame, edges: DataFrame, k: int, delta: float, c: int | None, t_end: int, labels: list[int] | None = None, algorithm: str | int = "plain") -> State:
    """The state after the snapshots of ``delta_cells``, (state.t_end, t_end].  Older snapshots are refused."""
    early = delta_cells.agg(F.min("t")).first()[0]
    if early is not None and early <= state.t_end:
        raise ValueError(f"snapshot {early} comes after snapshot {state.t_end} was mined")
    d, cc = relaxation(delta, c)
    retired, added = update_parts(state, delta_cells, edges, k, d, cc, labels, algorithm)
    members = stored(state.members.join(retired, ["s", "e", "comp"], "left_anti").unionByName(added), "motifs")
    rows = state.open_rows.unionByName(delta_cells.select("edge_id", "label", "t"))
    return State(t_end, stored(open_chains(rows, cc, t_end), "open"), members)
