"""Small graphs with known motifs, and a brute-force miner."""

from itertools import product

from motifloom.functions.index import EPS, relaxation

T1 = ([(1, 2), (2, 3), (4, 5)], ["11121111", "11111122", "33333333"])
T2 = ([(1, 2)], ["1211111111211"])
T3 = ([(1, 2), (2, 3)], ["112222", "111111"])


def frames(spark, graph):
    """(edges, cells) of a graph; edge ids from 0."""
    ends, labels = graph
    edges = spark.createDataFrame([(i, f"n{u}", f"n{v}") for i, (u, v) in enumerate(ends)], "edge_id long, u string, v string")
    cells = spark.createDataFrame([(i, t, int(x)) for i, row in enumerate(labels) for t, x in enumerate(row)], "edge_id long, t int, label int")
    return edges, cells


def valid(row, s, e, k, delta, c):
    """The rules, read literally off the labels of one edge."""
    if e - s + 1 < k or row[s] != row[e]:
        return False
    run = noise = 0
    for t in range(s, e + 1):
        run = 0 if row[t] == row[s] else run + 1
        noise += row[t] != row[s]
        if c is not None and run > c:
            return False
    return noise - delta * (e - s + 1) <= EPS


def brute(graph, k, delta, c):
    """The set of motifs (s, e, edge ids)."""
    ends, labels = graph
    delta, c = relaxation(delta, c)
    n = len(labels[0])
    ok = {(i, s, e) for i, s, e in product(range(len(ends)), range(n), range(n)) if e >= s and valid(labels[i], s, e, k, delta, c)}
    out = set()
    for s, e in product(range(n), range(n)):
        here = [i for i in range(len(ends)) if (i, s, e) in ok]
        while here:
            comp, nodes, grew = {here[0]}, set(ends[here[0]]), True
            while grew:
                grew = False
                for i in here:
                    if i not in comp and nodes & set(ends[i]):
                        comp.add(i)
                        nodes |= set(ends[i])
                        grew = True
            here = [i for i in here if i not in comp]
            if not any(all((i, a, b) in ok and labels[i][a] == labels[i][s] for i in comp) for a in range(s + 1) for b in range(e, n) if (a, b) != (s, e)):
                out.add((s, e, tuple(sorted(comp))))
    return out


def found(members):
    rows = {}
    for r in members.collect():
        rows.setdefault((r["s"], r["e"], r["comp"]), []).append(r["edge_id"])
    return {(s, e, tuple(sorted(ids))) for (s, e, _), ids in rows.items()}
