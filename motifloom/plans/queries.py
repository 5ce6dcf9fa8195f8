"""Every operator as a query over the tables of a folder, with its SQL where there is one.

Two graphs are derived from ordinary tables: ``events`` (users and event types by day) and ``trade``
(supplier and customer nations by month).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.functions import index
from motifloom.operators import analysis, intervals, mine, report
from motifloom.operators.connectivity import component_members, component_members_by_stars, components
from motifloom.operators.maximal import expandable, scopes
from motifloom.plans import oracle
from motifloom.sources import edge_list
from motifloom.sources.shared import shared_path, stored
from motifloom.streaming.append import MotifStream, snapshots

K, DELTA, C = 5, 0.2, 1
SPLIT = 19

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, cells = edge_list.events_graph(table(spark, sf_dir, "events"))
    return stored(edges, "edges"), stored(cells, "cells")


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, cells = edge_list.trade_graph(*(table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer")))
    return stored(edges, "edges"), stored(cells, "cells")


def listed(members: DataFrame) -> DataFrame:
    """(s, e, comp, size, ids, labels): one row per motif, with scalars and sorted lists as text."""
    m = components(members)
    text = lambda f: F.array_join(F.transform("edges", lambda x: x[f].cast("string")), ",")
    return m.select("s", "e", "comp", F.col("size").cast("long").alias("size"), text("edge_id").alias("ids"), text("label").alias("labels"))


def relaxed(spark: SparkSession, sf_dir: str, k: int = K, delta: float = DELTA, c: int | None = C, **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, cells = events(spark, sf_dir)
    return edges, cells, mine.motif_members(cells, edges, k, delta, c, **more)


E1, T2 = oracle.EVENTS, oracle.TRADE
MOTIFS = oracle.motifs(E1, K, DELTA, C)


@query("tg_dense", f"{E1} SELECT edge_id, t, label FROM cells")
def tg_dense(spark, sf_dir):
    return events(spark, sf_dir)[1]


@query("tg_dense_trade", f"{T2} SELECT edge_id, t, label FROM cells")
def tg_dense_trade(spark, sf_dir):
    return trade(spark, sf_dir)[1]


@query("tg_topology", f"{E1} SELECT edge_id, u, v FROM edges")
def tg_topology(spark, sf_dir):
    return events(spark, sf_dir)[0]


_RECORDS = f"{E1}, rec AS (SELECT u, v, t, label AS w FROM cells JOIN edges USING (edge_id))"


def _records(spark, sf_dir) -> DataFrame:
    edges, cells = events(spark, sf_dir)
    return cells.join(edges, "edge_id").select("u", "v", "t", F.col("label").alias("w"))


@query("first_topology", f"{_RECORDS} SELECT row_number() OVER (ORDER BY u, v) AS edge_id, u, v FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM rec WHERE t = (SELECT min(t) FROM rec))")
def first_topology(spark, sf_dir):
    return edge_list.topology(_records(spark, sf_dir))


@query("node_dict", f"{_RECORDS} SELECT row_number() OVER (ORDER BY node) AS id, node AS value FROM (SELECT u AS node FROM rec UNION SELECT v FROM rec)")
def node_dict(spark, sf_dir):
    out = edge_list.node_dictionary(_records(spark, sf_dir))
    return out.select("id", F.col("value"))


@query("label_dict", f"{T2} SELECT row_number() OVER (ORDER BY label) AS id, label AS value FROM (SELECT DISTINCT label FROM cells)")
def label_dict(spark, sf_dir):
    return edge_list.dictionary(trade(spark, sf_dir)[1].select("label"))


_LINES = "SELECT l_suppkey AS u, l_partkey AS v, CAST(l_linenumber AS INT) AS t, CAST(l_quantity AS INT) AS w, l_orderkey FROM lineitem"


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_linenumber").cast("int").alias("t"), F.col("l_quantity").cast("int").alias("w"), "l_orderkey")


@query("cell_dedupe", f"WITH r AS ({_LINES}), ends AS (SELECT row_number() OVER (ORDER BY u, v) AS edge_id, u, v FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM r)) SELECT edge_id, t, min_by(w, struct_pack(a := l_orderkey, b := w)) AS label FROM r JOIN ends ON ends.u = least(r.u, r.v) AND ends.v = greatest(r.u, r.v) GROUP BY edge_id, t")
def cell_dedupe(spark, sf_dir):
    lines = stored(_lines(spark, sf_dir), "lines")
    edges = edge_list.with_ids(lines.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "u", "v")
    return edge_list.label_cells(lines, edges, F.col("l_orderkey"))


@query("csv_edge_list", f"SELECT u, v, t, w FROM ({_LINES}) WHERE t > 1 AND t <= 5")
def csv_edge_list(spark, sf_dir):
    """Records written as text and read again, from the second snapshot to the fifth."""
    path = shared_path(spark, "edge-list")
    _lines(spark, sf_dir).drop("l_orderkey").write.csv(path)
    return edge_list.read_edge_list(spark, path, upto=5, after=1)


def _number_file(spark, numbers: DataFrame) -> str:
    path = shared_path(spark, "numbers")
    numbers.select(F.concat(F.lit(" "), numbers.columns[0], F.lit("\n")).alias("value")).write.text(path)
    return path


@query("k_list", "SELECT CAST(r_regionkey + 5 AS INT) AS k FROM region UNION ALL SELECT 10")
def k_list(spark, sf_dir):
    """Thresholds of a file with blank lines and spaces, then those of a file that is missing."""
    path = _number_file(spark, table(spark, sf_dir, "region").select((F.col("r_regionkey") + 5).cast("string")))
    numbers = edge_list.read_numbers(spark, path) + edge_list.read_numbers(spark, f"{path}-missing")
    return spark.createDataFrame([(n,) for n in numbers], "k int")


@query("label_list", f"{oracle.intervals(E1, K, DELTA, C)} SELECT edge_id, label, s, e, noise FROM ei WHERE label IN (SELECT r_regionkey FROM region WHERE r_regionkey BETWEEN 1 AND 2)")
def label_list(spark, sf_dir):
    """Fixed labels from a file."""
    path = _number_file(spark, table(spark, sf_dir, "region").filter("r_regionkey between 1 and 2").select(F.col("r_regionkey").cast("string")))
    return intervals.valid_intervals(events(spark, sf_dir)[1], K, DELTA, C, edge_list.read_numbers(spark, path))


@query("snapshot_prefix", f"{E1} SELECT edge_id, t, label FROM cells WHERE t <= {SPLIT}")
def snapshot_prefix(spark, sf_dir):
    return edge_list.limited(events(spark, sf_dir)[1], SPLIT)


@query("snapshot_delta", f"{E1} SELECT edge_id, t, label FROM cells WHERE t > {SPLIT} AND t <= 25")
def snapshot_delta(spark, sf_dir):
    return edge_list.limited(events(spark, sf_dir)[1], 25, SPLIT)


@query("virtual_share", f"{T2} SELECT edge_id, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::BIGINT AS n_virtual, count(*) AS n_cells FROM cells GROUP BY edge_id HAVING sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) < 0.5 * count(*)")
def virtual_share(spark, sf_dir):
    cells = trade(spark, sf_dir)[1]
    return edge_list.virtual_share(edge_list.drop_virtual(cells))


@query("spread_shares", "WITH x AS (SELECT event_id, user_id * 1.0 AS a, user_id + value / 50.0 AS b, value FROM events WHERE user_id IS NOT NULL AND value > 0), s AS (SELECT *, unnest(generate_series(CAST(floor(a / 4.0) AS INT), greatest(CAST(floor(a / 4.0) AS INT), CAST(ceil(b / 4.0) AS INT) - 1))) AS t FROM x) SELECT event_id, CAST(t AS INT) AS t, round(CASE WHEN b > a THEN value * (least(b, (t + 1) * 4.0) - greatest(a, t * 4.0)) / (b - a) ELSE value END, 6) AS value FROM s")
def spread_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("user_id is not null and value > 0")
    rows = rows.select("event_id", (F.col("user_id") * 1.0).cast("double").alias("a"), (F.col("user_id") + F.col("value") / 50.0).alias("b"), "value")
    return edge_list.spread(rows, "a", "b", "value", 4.0).select("event_id", "t", F.round("value", 6).alias("value"))


@query("run_bounds", f"{oracle.runs(E1)} SELECT edge_id, t, label, t - run_start + 1 AS bef, run_end - t + 1 AS aft FROM runs")
def run_bounds(spark, sf_dir):
    return index.run_bounds(events(spark, sf_dir)[1])


@query("run_links", f"{oracle.runs(E1)} SELECT *, lag(run_end) OVER w AS prev_end, lead(run_start) OVER w AS next_start FROM (SELECT DISTINCT edge_id, label, run_start, run_end FROM runs) WINDOW w AS (PARTITION BY edge_id, label ORDER BY run_start)")
def run_links(spark, sf_dir):
    return index.run_links(events(spark, sf_dir)[1])


@query("tail_last", f"{E1} SELECT edge_id, label, max(t) AS tail FROM cells GROUP BY edge_id, label")
def tail_last(spark, sf_dir):
    return index.tails(events(spark, sf_dir)[1])


@query("dif_cum", f"{oracle.occurrences(E1, C)} SELECT edge_id, t, label, dif, chain FROM occ")
def dif_cum(spark, sf_dir):
    return index.occurrences(events(spark, sf_dir)[1], C).select("edge_id", "t", "label", "dif", "chain")


@query("run_stats", f"{oracle.runs(E1)} SELECT max(n) AS max_runs, avg(n) AS avg_runs FROM (SELECT edge_id, count(DISTINCT run_start) AS n FROM runs GROUP BY edge_id)")
def run_stats(spark, sf_dir):
    return index.run_stats(events(spark, sf_dir)[1])


@query("label_pair_same", f"{E1} SELECT a.edge_id, a.label = b.label AS same FROM cells a JOIN cells b USING (edge_id) WHERE a.t = 3 AND b.t = 9")
def label_pair_same(spark, sf_dir):
    return index.same_label(events(spark, sf_dir)[1], 3, 9)


@query("label_sets_same", f"{E1} SELECT v AS set_id, bool_and(a.label = b.label) AS same FROM cells a JOIN cells b USING (edge_id) JOIN edges USING (edge_id) WHERE a.t = 3 AND b.t = 9 GROUP BY v")
def label_sets_same(spark, sf_dir):
    edges, cells = events(spark, sf_dir)
    return index.same_labels_of_sets(cells, edges.select(F.col("v").alias("set_id"), "edge_id"), 3, 9)


@query("label_lookup", f"{E1} SELECT edge_id, t, label FROM cells WHERE t = edge_id % 30")
def label_lookup(spark, sf_dir):
    edges, cells = events(spark, sf_dir)
    return index.label_at(cells, edges.select("edge_id", (F.col("edge_id") % 30).cast("int").alias("t")))


@query("graph_summary", f"{E1} SELECT (SELECT count(*) FROM (SELECT u FROM edges UNION SELECT v FROM edges)) AS nodes, count(DISTINCT edge_id) AS edges, count(DISTINCT t) AS snapshots, count(DISTINCT label) AS labels FROM cells")
def graph_summary(spark, sf_dir):
    return index.summary(*events(spark, sf_dir))


@query("exact_filter", f"{oracle.runs(E1)} SELECT edge_id, label, t AS s, run_start, run_end AS max_e FROM runs WHERE run_end - t + 1 >= {K}")
def exact_filter(spark, sf_dir):
    return intervals.exact_filter(events(spark, sf_dir)[1], K)


@query("exact_rset", f"{oracle.runs(E1)} SELECT t AS s, edge_id, label, run_end AS max_e FROM runs WHERE run_end - t + 1 >= {K}")
def exact_rset(spark, sf_dir):
    return intervals.exact_rset(events(spark, sf_dir)[1], K)


_EI = oracle.intervals(E1, K, DELTA, C)


def _ei(spark, sf_dir) -> DataFrame:
    return intervals.valid_intervals(events(spark, sf_dir)[1], K, DELTA, C)


@query("valid_intervals", f"{_EI} SELECT edge_id, label, s, e, noise FROM ei")
def valid_intervals(spark, sf_dir):
    return _ei(spark, sf_dir)


def _islands(ei: str) -> str:
    return f"{ei}, isle AS (SELECT edge_id, label, s, e, e - row_number() OVER (PARTITION BY edge_id, label, s ORDER BY e) AS g FROM ei) SELECT edge_id, label, s, min(e) AS lo, max(e) AS hi FROM isle GROUP BY edge_id, label, s, g"


@query("valid_ranges", _islands(_EI))
def valid_ranges(spark, sf_dir):
    return intervals.valid_ranges(events(spark, sf_dir)[1], K, DELTA, C)


@query("valid_ranges_trade", _islands(oracle.intervals(T2, 10, 0.15, 2)))
def valid_ranges_trade(spark, sf_dir):
    return intervals.valid_ranges(trade(spark, sf_dir)[1], 10, 0.15, 2)


@query("valid_intervals_trade", f"{oracle.intervals(T2, 10, DELTA, 2)} SELECT edge_id, label, s, e, noise FROM ei")
def valid_intervals_trade(spark, sf_dir):
    return intervals.valid_intervals(trade(spark, sf_dir)[1], 10, DELTA, 2)


@query("sel_stats", f"{_EI} SELECT max(n) AS max_sm, CAST(floor(avg(n)) AS BIGINT) AS aver_sm FROM (SELECT s, count(*) AS n FROM ei WHERE e - s + 1 = {K} GROUP BY s)")
def sel_stats(spark, sf_dir):
    return intervals.selection_stats(_ei(spark, sf_dir), K)


@query("rset_max_end", f"{_EI} SELECT s, edge_id, label, max(e) AS max_e FROM ei GROUP BY s, edge_id, label")
def rset_max_end(spark, sf_dir):
    return intervals.rset(_ei(spark, sf_dir))


@query("tabu_ends", f"{_EI}, r AS (SELECT edge_id, label, s, max(e) AS m FROM ei GROUP BY ALL), x AS (SELECT edge_id, label, s, CAST(unnest(generate_series(s + {K - 1}, m)) AS INT) AS e FROM r) SELECT edge_id, label, s, e FROM x ANTI JOIN ei USING (edge_id, label, s, e)")
def tabu_ends(spark, sf_dir):
    return intervals.tabu_ends(_ei(spark, sf_dir), K)


@query("tabu_ranges", f"{_EI}, r AS (SELECT edge_id, label, s, max(e) AS m FROM ei GROUP BY ALL), x AS (SELECT edge_id, label, s, CAST(unnest(generate_series(s + {K - 1}, m)) AS INT) AS e FROM r), y AS (SELECT *, e - row_number() OVER (PARTITION BY edge_id, label, s ORDER BY e) AS g FROM x ANTI JOIN ei USING (edge_id, label, s, e)) SELECT edge_id, label, s, min(e) AS lo, max(e) AS hi FROM y GROUP BY edge_id, label, s, g")
def tabu_ranges(spark, sf_dir):
    return intervals.tabu_ranges(_ei(spark, sf_dir), K)


@query("short_intervals", f"{oracle.runs(E1)} SELECT edge_id, label, t AS s, CAST(unnest(generate_series(t + 2, least(run_end, t + 3))) AS INT) AS e, 0 AS noise FROM runs")
def short_intervals(spark, sf_dir):
    return intervals.short_intervals(events(spark, sf_dir)[1], 3, DELTA)


@query("plus_equals_relaxed", f"{oracle.intervals(E1, 3, DELTA, C)} SELECT edge_id, label, s, e, noise FROM ei")
def plus_equals_relaxed(spark, sf_dir):
    return intervals.valid_intervals_split(events(spark, sf_dir)[1], 3, DELTA, C)


@query("label_filtered", f"{_EI} SELECT edge_id, label, s, e, noise FROM ei WHERE label IN (1, 2)")
def label_filtered(spark, sf_dir):
    return intervals.valid_intervals(events(spark, sf_dir)[1], K, DELTA, C, [1, 2])


@query("row_common_edges", f"{_EI}, r AS (SELECT DISTINCT s, edge_id FROM ei) SELECT a.s, count(b.s) AS n_common, count(*) - count(b.s) AS n_new FROM r a LEFT JOIN r b ON b.s = a.s - 1 AND b.edge_id = a.edge_id GROUP BY a.s")
def row_common_edges(spark, sf_dir):
    return intervals.row_common_edges(_ei(spark, sf_dir), K)


@query("current_noise", f"{oracle.occurrences(E1, C)}, p AS (SELECT edge_id, label, chain, max(t) AS l, max(dif) - min(dif) AS n FROM occ WHERE t <= {SPLIT} GROUP BY ALL) SELECT edge_id, label, {SPLIT} - l AS local, n AS chain_noise FROM p WHERE {SPLIT} - l <= {C}")
def current_noise(spark, sf_dir):
    return intervals.current_noise(events(spark, sf_dir)[1], C, SPLIT)


@query("last_interval", f"{_EI} SELECT edge_id, s, e FROM ei WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY e DESC, s DESC) = 1")
def last_interval(spark, sf_dir):
    return intervals.last_interval(_ei(spark, sf_dir), 0)


@query("overlap_filter", f"{_EI} SELECT edge_id, label, s, e, noise FROM ei WHERE e >= {SPLIT}")
def overlap_filter(spark, sf_dir):
    return intervals.overlapping(_ei(spark, sf_dir), SPLIT)


@query("components", f"{oracle.components(E1, K, DELTA, C)} SELECT s, e, comp, size, ids, labels FROM listed")
def components_query(spark, sf_dir):
    edges, cells = events(spark, sf_dir)
    return listed(component_members(intervals.valid_intervals(cells, K, DELTA, C), edges))


@query("components_stars", f"{oracle.components(E1, 10, DELTA, C)} SELECT s, e, comp, size, ids, labels FROM listed")
def components_stars(spark, sf_dir):
    """The components of graphs too large for one task an interval."""
    edges, cells = events(spark, sf_dir)
    rows = intervals.valid_intervals(cells, 10, DELTA, C).select("s", "e", "edge_id", "label").join(edges, "edge_id")
    return listed(component_members_by_stars(rows))


@query("expansion_scope", f"{oracle.components(E1, K, DELTA, C)}, {oracle.SCOPE} SELECT s, e, comp, lo, hi FROM scope")
def expansion_scope(spark, sf_dir):
    edges, cells = events(spark, sf_dir)
    ei = stored(intervals.valid_intervals(cells, K, DELTA, C), "intervals")
    return scopes(component_members(ei, edges), ei).select("s", "e", "comp", "lo", "hi")


@query("motifs_exact", oracle.motifs(E1, K, 0, 0) + oracle.LISTED)
def motifs_exact(spark, sf_dir):
    return listed(relaxed(spark, sf_dir, K, 0, 0)[2])


@query("motifs_relaxed", MOTIFS + oracle.LISTED)
def motifs_relaxed(spark, sf_dir):
    return listed(relaxed(spark, sf_dir)[2])


@query("motifs_plus", MOTIFS + oracle.LISTED)
def motifs_plus(spark, sf_dir):
    return listed(relaxed(spark, sf_dir, algorithm="plus")[2])


@query("motifs_trade", oracle.motifs(T2, 10, DELTA, 2) + oracle.LISTED)
def motifs_trade(spark, sf_dir):
    edges, cells = trade(spark, sf_dir)
    return listed(mine.motif_members(cells, edges, 10, DELTA, 2))


@query("motifs_unlimited_c", oracle.motifs(E1, K, DELTA, None) + oracle.LISTED)
def motifs_unlimited_c(spark, sf_dir):
    return listed(relaxed(spark, sf_dir, c=None)[2])


@query("overlap_count", oracle.motifs(E1, K, DELTA, None) + "SELECT count(*) AS motifs FROM motif")
def overlap_count(spark, sf_dir):
    return report.summary(relaxed(spark, sf_dir, c=None)[2]).select("motifs")


@query("motifs_labels", oracle.motifs(E1, K, DELTA, C, labels=(1, 2)) + oracle.LISTED)
def motifs_labels(spark, sf_dir):
    return listed(relaxed(spark, sf_dir, labels=[1, 2])[2])


@query("motifs_multi_k", f"SELECT 5 AS k, s, e, comp, size FROM ({MOTIFS} SELECT s, e, comp, size FROM motif) UNION ALL SELECT 10, s, e, comp, size FROM ({oracle.motifs(E1, 10, DELTA, C)} SELECT s, e, comp, size FROM motif)")
def motifs_multi_k(spark, sf_dir):
    edges, cells = events(spark, sf_dir)
    return mine.mine_many(cells, edges, [5, 10], DELTA, C).select("k", "s", "e", "comp", "size")


@query("motif_summary", MOTIFS + "SELECT max(size)::BIGINT AS max_edges, sum(size)::BIGINT AS all_edges, max(e - s + 1)::BIGINT AS max_length, avg(e - s + 1) AS avg_length, count(*) AS motifs FROM motif")
def motif_summary(spark, sf_dir):
    return report.summary(relaxed(spark, sf_dir)[2])


@query("motif_cells", MOTIFS + "SELECT s, e, count(*) AS motifs, string_agg(size::VARCHAR, ',' ORDER BY comp) AS sizes FROM motif GROUP BY s, e")
def motif_cells(spark, sf_dir):
    return report.by_interval(relaxed(spark, sf_dir)[2])


@query("motif_edges", MOTIFS + "SELECT s, e, comp, edge_id, u, v, label FROM member JOIN motif USING (s, e, comp) JOIN edges USING (edge_id)")
def motif_edges(spark, sf_dir):
    edges, _, members = relaxed(spark, sf_dir)
    return report.edges_with_labels(members, edges)


@query("motif_ids", MOTIFS + "SELECT s, e, comp, size, ids FROM motif")
def motif_ids(spark, sf_dir):
    return report.edge_ids(relaxed(spark, sf_dir)[2])


@query("motif_file", MOTIFS + "SELECT s, e, size::INT AS size, ids FROM motif")
def motif_file(spark, sf_dir):
    """Level 3 written as text and read again."""
    path = shared_path(spark, "motif-file")
    report.write_motifs(relaxed(spark, sf_dir)[2], path)
    return edge_list.read_motifs(spark, path).select("s", "e", "size", F.array_join(F.transform("edges", lambda x: x["edge_id"].cast("string")), ",").alias("ids"))


@query("open_chains", f"{oracle.occurrences(E1, C)}, p AS (SELECT * FROM occ WHERE t <= {SPLIT}), l AS (SELECT edge_id, label, chain FROM p GROUP BY ALL HAVING {SPLIT} - max(t) <= {C}) SELECT edge_id, label, t FROM p JOIN l USING (edge_id, label, chain)")
def open_chains(spark, sf_dir):
    return mine.open_chains(events(spark, sf_dir)[1], C, SPLIT)


def _state(spark, sf_dir):
    edges, cells = events(spark, sf_dir)
    return edges, cells, mine.mine_prefix(cells, edges, K, DELTA, C, SPLIT), edge_list.limited(cells, None, SPLIT)


@query("delta_intervals", f"{_EI} SELECT edge_id, label, s, e, noise FROM ei WHERE e > {SPLIT}")
def delta_intervals(spark, sf_dir):
    cells = events(spark, sf_dir)[1]
    return mine.delta_intervals(mine.open_chains(cells, C, SPLIT), edge_list.limited(cells, None, SPLIT), K, DELTA, C, SPLIT)


_BEFORE = oracle.motifs(E1, K, DELTA, C, upto=SPLIT)


@query("motifs_retired", f"SELECT s, e, comp FROM ({_BEFORE} SELECT s, e, comp, ids, labels FROM motif) ANTI JOIN ({MOTIFS} SELECT s, e, ids, labels FROM motif) USING (s, e, ids, labels)")
def motifs_retired(spark, sf_dir):
    edges, _, state, new = _state(spark, sf_dir)
    return mine.update_parts(state, new, edges, K, DELTA, C)[0]


@query("motifs_added", f"SELECT s, e, comp, size, ids, labels FROM ({MOTIFS} SELECT * FROM motif) WHERE e > {SPLIT}")
def motifs_added(spark, sf_dir):
    edges, _, state, new = _state(spark, sf_dir)
    return listed(mine.update_parts(state, new, edges, K, DELTA, C)[1])


@query("motifs_incremental", MOTIFS + oracle.LISTED)
def motifs_incremental(spark, sf_dir):
    edges, _, state, new = _state(spark, sf_dir)
    return listed(mine.update(state, new, edges, K, DELTA, C, 29).members)


@query("motifs_incremental_plus", MOTIFS + oracle.LISTED)
def motifs_incremental_plus(spark, sf_dir):
    """Prefix and update with short intervals taken from runs, chosen by number."""
    edges, cells = events(spark, sf_dir)
    state = mine.mine_prefix(cells, edges, K, DELTA, C, SPLIT, algorithm=33)
    return listed(mine.update(state, edge_list.limited(cells, None, SPLIT), edges, K, DELTA, C, 29, algorithm=34).members)


@query("expandable", f"{oracle.components(E1, K, DELTA, C)}, {oracle.LARGER} SELECT DISTINCT s, e, comp FROM larger")
def expandable_query(spark, sf_dir):
    edges, cells = events(spark, sf_dir)
    ei = stored(intervals.valid_intervals(cells, K, DELTA, C), "intervals")
    return expandable(stored(component_members(ei, edges), "members"), ei)


def _two(spark, sf_dir, c: int | None = 0):
    edges, cells = events(spark, sf_dir)
    first = mine.motif_members(cells, edges, K, 0, 0) if c == 0 else mine.motif_members(cells, edges, K, DELTA, c)
    return stored(first, "motifs"), stored(mine.motif_members(cells, edges, K, DELTA, C), "motifs")


_EXACT, _FREE = oracle.motifs(E1, K, 0, 0), oracle.motifs(E1, K, DELTA, None)


@query("compare_exact", oracle.compare(_EXACT, MOTIFS, 50))
def compare_exact(spark, sf_dir):
    return analysis.compare(*_two(spark, sf_dir))


@query("compare_unlimited", oracle.compare(_FREE, MOTIFS, None))
def compare_unlimited(spark, sf_dir):
    return analysis.compare(*_two(spark, sf_dir, None), most_edges=None)


@query("compare_summary", oracle.compare_summary(_EXACT, MOTIFS, 50))
def compare_summary(spark, sf_dir):
    exact, more = _two(spark, sf_dir)
    return analysis.comparison_summary(analysis.compare(exact, more), exact, more)


@query("self_containment", oracle.self_containment(oracle.motifs(E1, 3, 0.3, 2), 3, 0.3))
def self_containment(spark, sf_dir):
    return analysis.self_containment(stored(relaxed(spark, sf_dir, 3, 0.3, 2)[2], "motifs"), 3, 0.3)


@query("coverage", oracle.coverage(_EXACT, MOTIFS))
def coverage(spark, sf_dir):
    return analysis.coverage(*_two(spark, sf_dir))


@query("rarest_edge", oracle.rarest(_EXACT, MOTIFS))
def rarest_edge(spark, sf_dir):
    return analysis.rarest_edges(*_two(spark, sf_dir))


_PLANTED = "(s + e + comp) % 6"
_PLANTED_E = f"CASE {_PLANTED} WHEN 1 THEN s + 2 WHEN 2 THEN least(e + 1, 29) WHEN 4 THEN least(e + 4, 29) WHEN 5 THEN e - 1 ELSE e END"


@query("validate", MOTIFS + f", mo AS (SELECT m.* FROM member m SEMI JOIN motif USING (s, e, comp)), p AS (SELECT CASE {_PLANTED} WHEN 3 THEN s + 1 ELSE s END AS s, {_PLANTED_E} AS e, comp * 1000 + e * 10 + {_PLANTED} AS comp, edge_id, label FROM mo) {oracle.VALIDATE.format(k=K, delta=DELTA, c=C)}")
def validate(spark, sf_dir):
    """All motifs, most of them spoilt: cut short, moved or stretched at an end.  The sixth that is
    left as it was has no problem."""
    edges, cells, members = relaxed(spark, sf_dir)
    kind = F.expr(_PLANTED)
    spoilt = members.select(F.expr(f"CASE {_PLANTED} WHEN 3 THEN s + 1 ELSE s END").alias("s"), F.expr(_PLANTED_E).alias("e"), (F.col("comp") * 1000 + F.col("e") * 10 + kind).alias("comp"), "edge_id", "label")
    return analysis.validate(stored(spoilt, "motifs"), cells, stored(intervals.valid_intervals(cells, K, DELTA, C), "intervals"), K, DELTA, C)


@query("stream_append", MOTIFS + oracle.LISTED)
def stream_append(spark, sf_dir):
    """The snapshots as a stream of files, in batches of several days."""
    edges, cells = events(spark, sf_dir)
    miner = MotifStream(edges, K, DELTA, C, shared_path(spark, "motif-stream"))
    source, checkpoint = shared_path(spark, "snapshots"), shared_path(spark, "stream")
    for low, high in ((-1, SPLIT), (SPLIT, 24), (24, 29)):
        edge_list.limited(cells, high, low).coalesce(1).write.mode("append").parquet(source)
        miner.start(snapshots(spark, source), checkpoint).awaitTermination()
    return listed(miner.motifs)
