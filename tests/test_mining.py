import random

import pytest
from pyspark.sql import functions as F

from motifloom.functions.index import occurrences, run_bounds
from motifloom.operators import analysis, connectivity, report
from motifloom.operators.intervals import tabu_ends, tabu_ranges, valid_intervals, valid_intervals_split, valid_ranges
from motifloom.operators.mine import mine_many, mine_prefix, motif_members, plan_of, update
from motifloom.sources.edge_list import read_motifs
from tests.graphs import T1, T2, T3, brute, found, frames, valid


def graph_of(seed, nodes=5, n_edges=6, t=9, labels=2):
    rng = random.Random(seed)
    ends = sorted({tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(n_edges)})
    return ends, ["".join(str(rng.randint(1, labels)) if rng.random() < 0.5 else "1" for _ in range(t)) for _ in ends]


@pytest.mark.parametrize(
    ("graph", "k", "delta", "c", "expected"),
    [
        (T1, 3, 0, 0, {(0, 2, (0, 1)), (0, 5, (1,)), (0, 7, (2,)), (4, 7, (0,))}),
        (T1, 3, 0.25, 1, {(0, 5, (0, 1)), (0, 7, (0,)), (0, 7, (2,))}),
        (T1, 3, 0.1, 1, {(0, 2, (0, 1)), (0, 5, (1,)), (0, 7, (2,)), (4, 7, (0,))}),
        (T2, 2, 0.1, 1, {(0, 9, (0,)), (2, 12, (0,))}),
        (T3, 2, 0.2, 1, {(0, 1, (0, 1)), (0, 5, (1,)), (2, 5, (0, 1))}),
    ],
)
def test_known_motifs(spark, graph, k, delta, c, expected):
    edges, cells = frames(spark, graph)
    assert found(motif_members(cells, edges, k, delta, c)) == expected


@pytest.mark.parametrize(("seed", "k", "delta", "c"), [(1, 2, 0.3, 1), (2, 3, 0.34, 2), (3, 2, 0.5, None), (4, 3, 0, 0)])
def test_random_graphs(spark, seed, k, delta, c):
    graph = graph_of(seed)
    edges, cells = frames(spark, graph)
    ei = {(r["edge_id"], r["s"], r["e"]) for r in valid_intervals(cells, k, delta, c).collect()}
    n = len(graph[1][0])
    assert ei == {(i, s, e) for i, row in enumerate(graph[1]) for s in range(n) for e in range(s, n) if valid(row, s, e, k, delta if c != 0 else 0, c if delta else 0)}
    members = motif_members(cells, edges, k, delta, c)
    assert found(members) == brute(graph, k, delta, c)
    assert found(motif_members(cells, edges, k, delta, c, algorithm="plus")) == brute(graph, k, delta, c)
    if delta:
        assert analysis.validate(members, cells, valid_intervals(cells, k, delta, c), k, delta, c).count() == 0


def test_split_intervals_are_the_same(spark):
    _, cells = frames(spark, graph_of(7, t=14))
    for delta in (0.1, 0.2, 0.5):
        a = {tuple(r) for r in valid_intervals(cells, 2, delta, 2).select("edge_id", "label", "s", "e", "noise").collect()}
        b = {tuple(r) for r in valid_intervals_split(cells, 2, delta, 2).select("edge_id", "label", "s", "e", "noise").collect()}
        assert a == b


@pytest.mark.parametrize(("delta", "c"), [(0.1, 2), (0.25, 1), (0.4, None), (0, 0)])
def test_ranges_hold_the_valid_ends(spark, delta, c):
    _, cells = frames(spark, graph_of(13, t=15))
    a = {tuple(r) for r in valid_intervals(cells, 2, delta, c).select("edge_id", "label", "s", "e").collect()}
    rows = valid_ranges(cells, 2, delta, c).collect()
    b = [(r["edge_id"], r["label"], r["s"], e) for r in rows for e in range(r["lo"], r["hi"] + 1)]
    assert set(b) == a and len(b) == len(a) >= len(rows)


def test_components_by_stars_are_the_same(spark):
    edges, cells = frames(spark, graph_of(11, nodes=9, n_edges=9))
    ei = valid_intervals(cells, 2, 0.3, 1)
    a = {tuple(r) for r in connectivity.component_members(ei, edges).select("s", "e", "comp", "edge_id", "label").collect()}
    b = {tuple(r) for r in connectivity.component_members_by_stars(ei.select("s", "e", "edge_id", "label").join(edges, "edge_id")).collect()}
    assert a == b and a


@pytest.mark.parametrize(("seed", "split"), [(1, 4), (5, 6), (9, 3)])
def test_update_equals_mining_anew(spark, seed, split):
    graph = graph_of(seed, t=10)
    edges, cells = frames(spark, graph)
    state = mine_prefix(cells, edges, 2, 0.34, 2, split)
    state = update(state, cells.filter((F.col("t") > split) & (F.col("t") <= 7)), edges, 2, 0.34, 2, 7)
    state = update(state, cells.filter("t > 7"), edges, 2, 0.34, 2, 9)
    assert found(state.members) == brute(graph, 2, 0.34, 2)
    with pytest.raises(ValueError, match="after snapshot"):
        update(state, cells.filter("t = 5"), edges, 2, 0.34, 2, 9)


def test_label_filter_and_several_thresholds(spark):
    edges, cells = frames(spark, T1)
    assert found(motif_members(cells, edges, 3, 0, 0, labels=[3])) == {(0, 7, (2,))}
    assert found(motif_members(cells, edges, 3, 0.25, 1, labels=[1])) == {(0, 5, (0, 1)), (0, 7, (0,))}
    many = mine_many(cells, edges, [3, 6], 0.25, 1)
    assert {(r["k"], r["s"], r["e"]) for r in many.collect()} >= {(3, 0, 5), (6, 0, 5), (6, 0, 7)}


def test_index_columns(spark):
    _, cells = frames(spark, T2)
    rows = {r["t"]: r for r in run_bounds(cells).collect()}
    assert (rows[2]["bef"], rows[2]["aft"], rows[9]["bef"], rows[10]["aft"]) == (1, 8, 8, 1)
    dif = {r["t"]: (r["dif"], r["chain"]) for r in occurrences(cells, 1).collect()}
    assert dif[0] == (0, 0) and dif[12] == (2, 0) and dif[10] == (9, 1)


def test_tabu(spark):
    _, cells = frames(spark, T2)
    ei = valid_intervals(cells, 2, 0.1, 1)
    ends = {(r["s"], r["e"]) for r in tabu_ends(ei, 2).collect()}
    assert {(0, e) for e in range(1, 9)} <= ends and (2, 10) in ends and (2, 9) not in ends
    ranges = {(r["s"], r["lo"], r["hi"]) for r in tabu_ranges(ei, 2).collect()}
    assert (0, 1, 8) in ranges and (2, 10, 10) in ranges


def test_validator_finds_planted_motifs(spark):
    edges, cells = frames(spark, T2)
    ei = valid_intervals(cells, 2, 0.1, 1)
    planted = spark.createDataFrame([(0, 8, 0, 0, 1), (0, 1, 0, 0, 1), (3, 9, 0, 0, 1), (2, 2, 0, 0, 1)], "s int, e int, comp long, edge_id long, label int")
    assert {(r["s"], r["e"], r["problem"]) for r in analysis.validate(planted, cells, ei, 2, 0.1, 1).collect()} >= {(0, 8, "noise"), (0, 1, "ends"), (3, 9, "larger"), (2, 2, "short")}


def test_compare_and_coverage(spark):
    edges, cells = frames(spark, T1)
    exact, relaxed = motif_members(cells, edges, 3, 0, 0), motif_members(cells, edges, 3, 0.25, 1)
    got = {(r["s"], r["e"], r["comp"]): r["contained"] for r in analysis.compare(exact, relaxed).collect()}
    # [0,5] holds the exact [0,2] and [0,5]; [0,7] of edge 0 holds [4,7]; edge 2 holds its own
    assert got == {(0, 5, 0): 2, (0, 7, 0): 1, (0, 7, 2): 1}
    assert tuple(analysis.coverage(exact, relaxed).first()) == (4, 4, 3, 3, 1)
    assert analysis.comparison_summary(analysis.compare(exact, relaxed), exact, relaxed).first()["contained"] == 4


def test_reports_and_motif_files(spark, tmp_path):
    edges, cells = frames(spark, T1)
    members = motif_members(cells, edges, 3, 0, 0)
    assert report.summary(members).first().asDict() == {"max_edges": 2, "all_edges": 5, "max_length": 8, "avg_length": 5.25, "motifs": 4}
    assert {(r["s"], r["e"], r["sizes"]) for r in report.by_interval(members).collect()} == {(0, 2, "2"), (0, 5, "1"), (0, 7, "1"), (4, 7, "1")}
    assert report.edges_with_labels(members, edges).count() == 5
    report.write_motifs(members, f"file://{tmp_path}/m")
    again = {(r["s"], r["e"], tuple(x["edge_id"] for x in r["edges"])) for r in read_motifs(spark, f"file://{tmp_path}/m").collect()}
    assert again == found(members)


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "edge_id long, u string, v string")
    cells = spark.createDataFrame([], "edge_id long, t int, label int")
    assert motif_members(cells, edges, 2, 0.2, 1).count() == 0
    assert report.summary(motif_members(cells, edges, 2, 0.2, 1)).first()["motifs"] == 0


def test_algorithms_by_number():
    assert plan_of(12) == plan_of("plain") == plan_of(23) == "plain" and plan_of(31) == plan_of(34) == "plus"
    for wrong in (99, "other"):
        with pytest.raises(ValueError):
            plan_of(wrong)


def test_unsettled_stars_are_an_error(spark):
    rows = [(0, 1, i, 0, f"n{i:02}", f"n{i + 1:02}") for i in range(12)]
    with pytest.raises(RuntimeError):
        connectivity.component_members_by_stars(spark.createDataFrame(rows, "s int, e int, edge_id long, label int, u string, v string"), max_rounds=1)
