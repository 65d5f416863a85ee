"""The search against a plain sequential model on random multigraphs: paths, their order and the counters."""

import random

import pytest

import pathloom as pl


def model(edges, starts, ok, stops, depth, most, revisits, strategy):
    """One path after the other, as a stack (dfs) or level by level (bfs)."""
    out = {}
    for e, (s, t) in sorted(edges.items()):
        out.setdefault(s, []).append((e, t))
    c = dict(evaluated_edges=0, accepted_edges=0, rejected_edges=0, skipped_revisits=0, stopped_paths=0)
    found, waiting = [], [((s,), ()) for s in starts]
    if most == 0:
        return [], c

    def expand(path):
        nodes, trail = path
        for e, t in out.get(nodes[-1], []):
            if nodes.count(t) > revisits:
                c["skipped_revisits"] += 1
                continue
            c["evaluated_edges"] += 1
            if e not in ok:
                c["rejected_edges"] += 1
                continue
            yield (nodes + (t,), trail + (e,)), t in stops

    if strategy == "dfs":
        while waiting:
            path = waiting.pop()
            if depth is not None and len(path[1]) >= depth:
                continue
            for child, stopped in expand(path):
                c["accepted_edges"] += 1
                if not stopped:
                    waiting.append(child)
                    continue
                c["stopped_paths"] += 1
                found.append(child)
                if len(found) == most:
                    return found, c
        return found, c
    while waiting and (depth is None or len(waiting[0][1]) < depth):
        following = []
        for path in waiting:
            for child, stopped in expand(path):
                c["accepted_edges"] += 1
                c["stopped_paths"] += stopped
                (found if stopped else following).append(child)
        waiting = following
        if most is not None and len(found) >= most:
            return found[:most], c
    return found, c


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n, m = 6, 14
    edges = {i: (r.randrange(n), r.randrange(n)) for i in range(m)}
    ok, stops = {i for i in edges if r.random() < 0.85}, {r.randrange(n), r.randrange(n)}
    g = pl.Graph(spark.createDataFrame([(i, i in stops) for i in range(n)], "id long, end boolean"), spark.createDataFrame([(i, a, b, i in ok) for i, (a, b) in edges.items()], "id long, src long, dest long, ok boolean"))
    starts = [r.randrange(n) for _ in range(3)]
    for strategy, most, revisits in (("dfs", None, 0), ("dfs", 3, 1), ("bfs", 4, 0)):
        paths, counters = model(edges, starts, ok, stops, 4, most, revisits, strategy)
        got = g.search(start_nodes=starts, visit=pl.col("edge.ok"), stop=pl.col("dest.end"), max_depth=4, max_paths=most, strategy=strategy, max_revisits_per_node=revisits)
        assert [(tuple(p.nodes), tuple(p.edges)) for p in got.paths] == paths
        assert {k: getattr(got.stats, k) for k in counters} == counters
