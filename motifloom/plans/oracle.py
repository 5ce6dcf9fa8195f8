"""The same results in plain SQL, for checking: common table expressions over the source tables."""

from __future__ import annotations

EVENTS = """WITH RECURSIVE ev AS (SELECT user_id, event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
cnt AS (SELECT user_id, event_type, t, CAST(least(count(*), 2) AS INT) AS label FROM ev WHERE t BETWEEN 0 AND 29 GROUP BY ALL),
ends AS (SELECT row_number() OVER (ORDER BY user_id, event_type) AS edge_id, user_id AS a, event_type AS b FROM (SELECT DISTINCT user_id, event_type FROM cnt)),
edges AS (SELECT edge_id, 'u:' || a AS u, 'v:' || b AS v FROM ends),
cells AS (SELECT ends.edge_id, CAST(g.t AS INT) AS t, coalesce(cnt.label, 0) AS label FROM ends CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS t) g LEFT JOIN cnt ON cnt.user_id = a AND cnt.event_type = b AND cnt.t = g.t)"""

TRADE = """WITH RECURSIVE sold AS (SELECT s_nationkey::BIGINT AS a, c_nationkey::BIGINT AS b, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS t, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
cnt AS (SELECT a, b, t, CASE WHEN sum(l_quantity) < 50 THEN 1 WHEN sum(l_quantity) < 200 THEN 2 ELSE 3 END AS label FROM sold WHERE t BETWEEN 0 AND 82 GROUP BY a, b, t),
ends AS (SELECT row_number() OVER (ORDER BY a, b) AS edge_id, a, b FROM (SELECT DISTINCT a, b FROM cnt)),
edges AS (SELECT edge_id, 'u:' || a AS u, 'v:' || b AS v FROM ends),
cells AS (SELECT ends.edge_id, CAST(g.t AS INT) AS t, coalesce(cnt.label, 0) AS label FROM ends CROSS JOIN (SELECT unnest(generate_series(0, 82)) AS t) g LEFT JOIN cnt ON cnt.a = ends.a AND cnt.b = ends.b AND cnt.t = g.t)"""

LARGER = """held AS (SELECT m.s, m.e, m.comp, y.s AS s2, y.e AS e2, count(*) AS n FROM member m JOIN ei y ON y.edge_id = m.edge_id AND y.label = m.label AND y.s <= m.s AND y.e >= m.e AND (y.s < m.s OR y.e > m.e) GROUP BY ALL),
larger AS (SELECT h.s, h.e, h.comp, h.s2, h.e2 FROM held h JOIN listed l ON l.s = h.s AND l.e = h.e AND l.comp = h.comp WHERE h.n = l.size)"""

SCOPE = """far AS (SELECT edge_id, label, s, e, max(e) OVER (PARTITION BY edge_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ei),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY edge_id, label ORDER BY s, e) AS g FROM far),
cover AS (SELECT edge_id, label, min(s) AS lo, max(e) AS hi FROM numbered GROUP BY edge_id, label, g),
bound AS (SELECT m.s, m.e, m.comp, m.edge_id, m.label, y.lo, y.hi FROM member m JOIN cover y ON y.edge_id = m.edge_id AND y.label = m.label AND y.lo <= m.s AND y.hi >= m.e),
scope AS (SELECT s, e, comp, max(lo) AS lo, min(hi) AS hi FROM bound GROUP BY ALL)"""

LISTED = " SELECT s, e, comp, size, ids, labels FROM motif"


def runs(base: str) -> str:
    return base + """, isl AS (SELECT *, t - row_number() OVER (PARTITION BY edge_id, label ORDER BY t) AS g FROM cells),
runs AS (SELECT edge_id, t, label, min(t) OVER w AS run_start, max(t) OVER w AS run_end FROM isl WINDOW w AS (PARTITION BY edge_id, label, g))"""


def occurrences(base: str, c: int | None, upto: int | None = None) -> str:
    where = f" WHERE t <= {upto}" if upto is not None else ""
    return base + f""", num AS (SELECT edge_id, t, label, CAST(t + 1 - row_number() OVER (PARTITION BY edge_id, label ORDER BY t) AS INT) AS dif, t - lag(t) OVER (PARTITION BY edge_id, label ORDER BY t) - 1 AS gap FROM cells{where}),
occ AS (SELECT edge_id, t, label, dif, CAST(sum(CASE WHEN gap > {c if c is not None else 10**9} THEN 1 ELSE 0 END) OVER (PARTITION BY edge_id, label ORDER BY t) AS INT) AS chain FROM num)"""


def intervals(base: str, k: int, delta: float, c: int | None, labels: tuple[int, ...] | None = None, upto: int | None = None) -> str:
    keep = f" AND a.label IN ({', '.join(map(str, labels))})" if labels else ""
    return occurrences(base, c, upto) + f""", ei AS (SELECT a.edge_id, a.label, a.t AS s, b.t AS e, b.dif - a.dif AS noise FROM occ a JOIN occ b ON a.edge_id = b.edge_id AND a.label = b.label AND a.chain = b.chain AND b.t - a.t + 1 >= {k} WHERE b.dif - a.dif - CAST({delta} AS DOUBLE) * (b.t - a.t + 1) <= 1e-7{keep})"""


def components(base: str, k: int, delta: float, c: int | None, labels: tuple[int, ...] | None = None, upto: int | None = None) -> str:
    return intervals(base, k, delta, c, labels, upto) + """, adj AS (SELECT s, e, u AS x, v AS y FROM ei JOIN edges USING (edge_id) UNION SELECT s, e, v, u FROM ei JOIN edges USING (edge_id)),
reach AS (SELECT s, e, x AS node, x AS root FROM adj UNION SELECT a.s, a.e, a.y, r.root FROM reach r JOIN adj a ON r.s = a.s AND r.e = a.e AND r.node = a.x),
top AS (SELECT s, e, node, min(root) AS root FROM reach GROUP BY ALL),
member AS (SELECT ei.s, ei.e, min(ei.edge_id) OVER (PARTITION BY ei.s, ei.e, top.root) AS comp, ei.edge_id, ei.label FROM ei JOIN edges USING (edge_id) JOIN top ON top.s = ei.s AND top.e = ei.e AND top.node = edges.u),
listed AS (SELECT s, e, comp, count(*) AS size, string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) AS ids, string_agg(label::VARCHAR, ',' ORDER BY edge_id) AS labels FROM member GROUP BY ALL)"""


def motifs(base: str, k: int, delta: float, c: int | None, labels: tuple[int, ...] | None = None, upto: int | None = None) -> str:
    """Ends with the relations ``motif`` (s, e, comp, size, ids, labels) and ``member``."""
    return components(base, k, delta, c, labels, upto) + f""", {LARGER},
motif AS (SELECT s, e, comp, size, ids, labels FROM listed ANTI JOIN larger USING (s, e, comp)) """


def _pairs(first: str, second: str, interval: str, most: int | None) -> str:
    """Relations x and y (the motif sets), their members and ``inside``."""
    cap = f" WHERE size <= {most}" if most else ""
    part = "SELECT m.s, m.e, m.comp, m.edge_id, motif.size FROM member m JOIN motif USING (s, e, comp)"
    return f"""WITH xa AS MATERIALIZED (SELECT * FROM ({first} {part})), ya AS MATERIALIZED (SELECT * FROM ({second} {part})), x AS (SELECT * FROM xa{cap}), y AS (SELECT * FROM ya{cap}),
inside AS (SELECT x.s, x.e, x.comp, x.size, y.s AS s2, y.e AS e2, y.comp AS comp2, y.size AS size2 FROM x JOIN y ON x.edge_id = y.edge_id AND {interval} GROUP BY ALL HAVING count(*) = x.size)"""


_WITHIN = "y.s <= x.s AND x.e <= y.e"


def compare(first: str, second: str, most: int | None) -> str:
    return _pairs(first, second, _WITHIN, most) + " SELECT s, e, comp, coalesce(c, 0) AS contained, coalesce(a, 0) AS contained_all FROM (SELECT DISTINCT s, e, comp FROM y) LEFT JOIN (SELECT s2 AS s, e2 AS e, comp2 AS comp, count(DISTINCT (s, e)) AS c, count(*) AS a FROM inside GROUP BY ALL) USING (s, e, comp)"


def compare_summary(first: str, second: str, most: int | None) -> str:
    return (
        _pairs(first, second, _WITHIN, most)
        + """, per AS (SELECT s2, e2, comp2, count(DISTINCT (s, e)) AS c FROM inside GROUP BY ALL), f AS (SELECT count(*) AS containing, count(*) FILTER (c = 1) AS containing_one, coalesce(sum(c), 0)::BIGINT AS contained FROM per),
t AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT s, e, comp FROM xa)) AS originals, (SELECT count(*) FROM (SELECT DISTINCT s, e, comp FROM ya)) AS relaxed)
SELECT containing, containing_one, contained, originals, relaxed, containing / nullif(relaxed, 0) AS containing_share, containing_one / nullif(relaxed, 0) AS one_share, contained / nullif(relaxed, 0) AS mean_contained, contained / nullif(originals, 0) AS contained_share FROM f, t"""
    )


def self_containment(one: str, k: int, delta: float) -> str:
    gap = f"(y.e - y.s + 1) * CAST({delta} AS DOUBLE) / (1 - CAST({delta} AS DOUBLE))"
    return (
        _pairs(one, one, f"x.s > y.s AND x.e < y.e AND x.s <= y.e - {k} AND NOT (x.e - x.s + 1 - {gap} < 1e-7) AND {gap} - {k} >= -1e-7", None)
        + f" SELECT s, e, comp, coalesce(c, 0) AS contained FROM (SELECT DISTINCT s, e, comp FROM y WHERE {gap} - {k} >= -1e-7) LEFT JOIN (SELECT s2 AS s, e2 AS e, comp2 AS comp, count(DISTINCT (s, e)) AS c FROM inside GROUP BY ALL) USING (s, e, comp)"
    )


def coverage(first: str, second: str) -> str:
    return (
        _pairs(first, second, _WITHIN, None)
        + " SELECT count(DISTINCT (s, e, comp)) AS covered, (SELECT count(*) FROM (SELECT DISTINCT s, e, comp FROM x)) AS originals, count(DISTINCT (s2, e2, comp2)) AS covering, (SELECT count(*) FROM (SELECT DISTINCT s, e, comp FROM y)) AS relaxed, count(*) FILTER (s = s2 AND e = e2 AND size = size2) AS same FROM inside"
    )


def rarest(first: str, second: str) -> str:
    return (
        _pairs(first, second, _WITHIN, None)
        + ", f AS (SELECT edge_id, count(*) AS n FROM y GROUP BY edge_id) SELECT s, e, comp, x.edge_id, coalesce(n, 0) AS n FROM x LEFT JOIN f USING (edge_id) QUALIFY row_number() OVER (PARTITION BY s, e, comp ORDER BY coalesce(n, 0), x.edge_id) = 1"
    )


#: Problems of the planted motifs p (s, e, comp, edge_id, label), read off the cells of each interval.
VALIDATE = """, hit AS (SELECT p.s, p.e, p.comp, p.edge_id, p.label, x.t, x.t - lag(x.t) OVER (PARTITION BY p.s, p.e, p.comp, p.edge_id ORDER BY x.t) - 1 AS gap FROM p JOIN cells x ON x.edge_id = p.edge_id AND x.label = p.label AND x.t BETWEEN p.s AND p.e),
seen AS (SELECT s, e, comp, edge_id, min(t) AS lo, max(t) AS hi, max(gap) AS gap, count(*) AS n FROM hit GROUP BY s, e, comp, edge_id),
bad AS (SELECT p.s, p.e, p.comp, CASE WHEN p.e - p.s + 1 < {k} THEN 'short' WHEN n IS NULL OR lo <> p.s OR hi <> p.e THEN 'ends' WHEN gap > {c} THEN 'block' WHEN (p.e - p.s + 1 - n) - CAST({delta} AS DOUBLE) * (p.e - p.s + 1) > 1e-7 THEN 'noise' END AS problem FROM p LEFT JOIN seen USING (s, e, comp, edge_id)),
big AS (SELECT p.s, p.e, p.comp, y.s AS s2, y.e AS e2, count(*) AS n FROM p JOIN ei y ON y.edge_id = p.edge_id AND y.label = p.label AND y.s <= p.s AND y.e >= p.e AND (y.s < p.s OR y.e > p.e) GROUP BY ALL),
psize AS (SELECT s, e, comp, count(*) AS n FROM p GROUP BY ALL)
SELECT DISTINCT s, e, comp, problem FROM bad WHERE problem IS NOT NULL UNION SELECT s, e, comp, 'larger' FROM big JOIN psize USING (s, e, comp, n)"""
