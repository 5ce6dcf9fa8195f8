import pytest
from pyspark.sql import functions as F

from motifloom.operators.mine import mine
from motifloom.sources import edge_list
from motifloom.sources.edge_list import densify, label_cells, label_dictionary, node_dictionary, read_edge_list, read_numbers, spread, topology, with_ids
from motifloom.streaming.append import MotifStream, snapshots
from tests.graphs import T1, brute, found, frames

LINES = "1,2,0,5\n3,2,0,6\n1,2,1,5\n2,1,1,9\n2,3,1,6\n1,2,2,7\n2,3,2,6\n"


@pytest.fixture
def records(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text(LINES)
    return lambda **how: read_edge_list(spark, f"file://{path}", **how)


def test_edge_list(spark, records):
    edges = topology(records())
    assert [tuple(r) for r in edges.orderBy("edge_id").collect()] == [(1, 1, 2), (2, 2, 3)]
    cells = label_cells(records(), edges)
    assert {tuple(r) for r in cells.collect()} == {(1, 0, 5), (1, 1, 5), (1, 2, 7), (2, 0, 6), (2, 1, 6), (2, 2, 6)}
    assert records(upto=1).count() == 5 and records(upto=0).count() == 2 and records(after=1).count() == 2
    assert [r["value"] for r in node_dictionary(records()).orderBy("id").collect()] == [1, 2, 3]
    assert [r["value"] for r in label_dictionary(records()).orderBy("id").collect()] == [5, 6, 7, 9]
    motifs = mine(cells, edges.select("edge_id", F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")), 2, 0, 0).collect()
    assert {(r["s"], r["e"], r["size"]) for r in motifs} == {(0, 1, 2), (0, 2, 1)}


def test_malformed_lines_and_late_edges_fail(spark, tmp_path, records):
    (tmp_path / "bad.csv").write_text("1,2,0,x\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_edge_list(spark, f"file://{tmp_path}/bad.csv").collect()
    edges = topology(records())
    late = records().unionAll(spark.createDataFrame([(7, 8, 1, 1)], edge_list.SCHEMA))
    with pytest.raises(Exception, match="missing from the first snapshot"):
        label_cells(late, edges).collect()


def test_numbers(spark, tmp_path):
    (tmp_path / "k.txt").write_text("10\n 5\n\n")
    assert read_numbers(spark, f"file://{tmp_path}/k.txt") == [10, 5]
    assert read_numbers(spark, f"file://{tmp_path}/none.txt") == [10]


def test_ids_by_ranges_are_the_same(spark, monkeypatch):
    keys = spark.range(500).select((F.col("id") * 37 % 1009).alias("k"))
    a = {tuple(r) for r in with_ids(keys, "k").collect()}
    monkeypatch.setattr(edge_list, "ONE_TASK_IDS", 10)
    assert {tuple(r) for r in with_ids(keys, "k").collect()} == a


def test_densify_and_spread(spark):
    edges = spark.createDataFrame([(1,), (2,)], "edge_id long")
    cells = spark.createDataFrame([(1, 1, 4)], "edge_id long, t int, label int")
    assert {tuple(r) for r in densify(cells, edges, 0, 2).collect()} == {(1, 0, 0), (1, 1, 4), (1, 2, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0)}
    rows = spark.createDataFrame([(1, 0.0, 10.0, 10.0), (2, 4.0, 4.0, 3.0), (3, 5.0, 15.0, 20.0)], "i int, a double, b double, x double")
    assert {(r["i"], r["t"], r["x"]) for r in spread(rows, "a", "b", "x", 5.0).collect()} == {(1, 0, 5.0), (1, 1, 5.0), (2, 0, 3.0), (3, 1, 10.0), (3, 2, 10.0)}


def test_stream_equals_batch(spark, tmp_path):
    edges, cells = frames(spark, T1)
    source, home = f"file://{tmp_path}/in", f"file://{tmp_path}/home"
    for low, high in ((0, 4), (5, 5), (6, 7)):
        cells.filter(F.col("t").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        miner = MotifStream(edges, 3, 0.25, 1, home)  # as after a restart
        miner.start(snapshots(spark, source), f"file://{tmp_path}/check").awaitTermination()
    assert found(miner.motifs) == brute(T1, 3, 0.25, 1)
    miner.append(cells.filter("t = 3"), 0)  # a batch that was taken already
    assert found(MotifStream(edges, 3, 0.25, 1, home).motifs) == brute(T1, 3, 0.25, 1)
    with pytest.raises(ValueError, match="was mined"):
        miner.append(cells.filter("t = 3"), 99)
