"""Orders and reach in policies of any length, with cycles, against plain versions."""

import heapq
import random

from colloquy.operators.policy import reachable_from, topological_order


def kahn(nodes, edges):
    """Step -> (depth, place) of one policy, by a queue that is kept in step order."""
    ord_ = {}
    for s, o in nodes:
        ord_[s] = min(o, ord_.get(s, o))
    edges = {(a, b) for a, b in edges if b in ord_}
    waits = {s: sum(b == s for _, b in edges) for s in ord_}
    ready, depth, out = [(ord_[s], s) for s, n in waits.items() if not n], dict.fromkeys(ord_, 0), {}
    heapq.heapify(ready)
    while ready:
        _, s = heapq.heappop(ready)
        out[s] = (depth[s], len(out) + 1)
        for b in {b for a, b in edges if a == s}:
            depth[b] = max(depth[b], depth[s] + 1)
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, (ord_[b], b))
    return {s: out.get(s, (None, None)) for s in ord_}


def reach(edges, start, taken):
    found, todo = set(), list(start)
    while todo:
        if (s := todo.pop()) not in found:
            found.add(s)
            todo += [b for a, b, kind, cond in edges if a == s and (kind != "branch" or (a, cond) in taken)]
    return found


def graphs(seed):
    r = random.Random(seed)
    chain = [(f"s{i:03d}", f"s{i + 1:03d}") for i in range(200)]
    out = {0: ([(f"s{i:03d}", 200 - i) for i in range(201)], chain), 1: ([(f"s{i:03d}", i) for i in range(201)], [*chain, ("s150", "s100"), ("s100", "s150")]), 2: ([("a", 1), ("b", 1), ("a", 0)], [("x", "b"), ("b", "y"), ("a", "a2")])}
    for p in range(3, 25):
        n = r.randrange(1, 12)
        out[p] = ([(f"t{i}", r.randrange(4)) for i in range(n)], [(f"t{r.randrange(n)}", f"t{r.randrange(n)}") for _ in range(r.randrange(n + 3))])
    return out


def test_orders(spark):
    given = graphs(1)
    nodes = spark.createDataFrame([(p, *n) for p, (own, _) in given.items() for n in own], "scenario_id long, step_id string, ord long")
    edges = spark.createDataFrame([(p, a, b) for p, (_, own) in given.items() for a, b in own + own[:1]], "scenario_id long, src string, dst string")
    got = {(r.scenario_id, r.step_id): (r.depth, r.pos) for r in topological_order(edges, nodes).collect()}
    assert got == {(p, s): x for p, (own, links) in given.items() for s, x in kahn(own, links).items()}
    assert got[0, "s200"] == (200, 201) and got[1, "s099"] == (99, 100) and got[1, "s120"] == got[1, "s180"] == (None, None)


def test_reach(spark):
    r = random.Random(2)
    given = {p: [(a, b, *r.choice([("sequential", None), ("branch", "x"), ("branch", "y"), ("skip", None)] if p > 2 else [("skip", None)])) for a, b in links] for p, (_, links) in graphs(3).items()}
    start = [(p, {0: "s000", 1: "s120", 2: "a"}.get(p, "t0")) for p in given] + [(99, "alone")]
    taken = [(p, f"t{i}", r.choice("xy")) for p in given for i in range(12) if r.random() < 0.6]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    edges = df([(p, *e) for p, own in given.items() for e in own], "scenario_id long, src string, dst string, kind string, cond string")
    got = reachable_from(edges, df(start, "scenario_id long, step_id string"), df(taken, "scenario_id long, step_id string, cond string")).collect()
    want = {(p, s) for p, own in start for s in reach(given.get(p, []), [own], {(s, c) for q, s, c in taken if q == p})}
    assert {tuple(x) for x in got} == want and len(got) == len(want) and (0, "s200") in want and (1, "s110") in want
    assert reachable_from(edges, df([], "scenario_id long, step_id string")).count() == 0


def test_long_policies_are_not_folded(spark):
    """One policy of 6000 steps, twice as many edges and a cycle at its end; a fold over all steps for each step takes minutes."""
    n = 6000
    steps = [f"s{i:05d}" for i in range(n)]
    links = [(steps[i], steps[i + k]) for i in range(n) for k in (1, 3) if i + k < n] + [(steps[-1], steps[-9])]
    own = [(s, (i * 7) % 101) for i, s in enumerate(steps)]
    nodes = spark.createDataFrame([(1, *x) for x in own], "scenario_id long, step_id string, ord long")
    edges = spark.createDataFrame([(1, *x) for x in links], "scenario_id long, src string, dst string")
    df = topological_order(edges, nodes)
    got = {r.step_id: (r.depth, r.pos) for r in df.collect()}
    assert [got[s] for s in steps[: n - 9]] == [(i, i + 1) for i in range(n - 9)] and {got[s] for s in steps[n - 9 :]} == {(None, None)}
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
