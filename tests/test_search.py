"""Turns, replays, reachability and fixed-order routes on the fixture graph, and against brute force."""

import heapq
import random

import pytest

from wayfold.operators import outcomes, search, turns

EDGES = "edge_id string, from_node bigint, to_node bigint, cost bigint, length bigint, mask int, x double, y double"
TURNS = "in_edge string, out_edge string, turn_cost bigint"
# w, l, k stand for places 0, 1, 2; o for a road outside; costs in tenths
ROWS = [("w", 0, 1, 10, 10, 1, 0.0, 0.0), ("l", 1, 2, 20, 20, 2, 1.0, 0.0), ("k", 2, 3, 30, 30, 4, 2.0, 0.0), ("lk", 1, 3, 40, 40, 6, 2.0, 0.0), ("o", 1, 1, 5, 5, 0, 0.5, 0.0)]


def graph(spark, *pairs):
    return search.RoadGraph(spark.createDataFrame(ROWS, EDGES), spark.createDataFrame([(a, b, c) for a, b, c in pairs], TURNS))


def test_steps_without_other_places(spark):
    """Edges in places that an order lacks are left out before the rounds; a table without parallel turns is not reduced again."""
    g = graph(spark, ("w", "lk", 5), ("w", "l", 5), ("l", "o", 1))
    left = lambda *orders: sorted(r["out_edge"] for r in g.steps().where(search.off_order(*orders)).collect())
    assert left([0, 1]) == ["l", "o"] and left([0, 1], [2]) == ["l", "lk", "o"]
    once = search.RoadGraph(g.edges, g.turns, unique=True)
    assert sorted(map(tuple, once.steps().collect())) == sorted(map(tuple, g.steps().collect()))
    assert search.FixedOrder(once, "w", [0, 1]).goal_label()[:2] == (35, 30) and search.FixedOrder(once, "w", [0, 2]).outcome()["category"] == "UNREACHABLE"


def test_fixture_routes(spark):
    g = graph(spark, ("w", "l", 5), ("w", "l", 9), ("l", "k", 5))
    f = search.FixedOrder(g, "w", [0, 1, 2])
    assert f.outcome()["category"] == "FEASIBLE" and f.goal_label()[:2] == (70, 60) and f.path() == ["w", "l", "k"]
    assert search.FixedOrder(g, "w", [0], free_start=True).goal_label()[:2] == (0, 0)
    early = search.FixedOrder(graph(spark, ("w", "lk", 5)), "w", [0, 2, 1]).outcome()
    assert (early["category"], early["reason"]) == ("ORDER_INVALID_BY_FIRST_HIT", "w->lk")
    assert search.FixedOrder(graph(spark, ("w", "lk", 5)), "w", [0, 1, 2]).goal_label()[0] == 55
    assert search.FixedOrder(graph(spark, ("w", "o", 0), ("o", "l", 0)), "w", [0, 1]).path() == ["w", "o", "l"]
    lone = search.FixedOrder(graph(spark, ("k", "k", 0)), "w", [0, 1]).outcome()
    assert lone["category"] == "UNREACHABLE" and "zero outgoing" in lone["reason"]
    assert search.attempt(g, "r", [0, 1], "none")["category"] == "INVALID_INPUT"
    rows = search.evaluated(g, [("a", [0, 1, 2]), ("b", [0, 2, 1]), ("c", [0, 1, 2])], "w")
    assert {r["route"]: r["category"] for r in rows.collect()}["c"] == "FEASIBLE"
    counts = {r["category"]: r["n"] for r in outcomes.histogram(rows, "category").collect()}
    assert counts["FEASIBLE"] == 2 and sum(counts.values()) == 3 and len(counts) == len(search.CATEGORIES)
    assert outcomes.status(counts, 3) == "SUCCESS" and outcomes.status(counts, 4) == "VALIDATION_FAILURE"
    assert g.first_edge(2).first()["edge_id"] == "k"
    path = spark.createDataFrame([("a", i, e) for i, e in enumerate("wlk")] + [("b", 0, "w"), ("b", 1, "k"), ("c", 0, "w"), ("c", 1, "none")], "route string, pos int, edge_id string")
    got = {r["route"]: r for r in turns.replayed(path, g.edges, g.turns, 3).collect()}
    assert (got["a"]["cost"], got["a"]["length"], got["a"]["order"], got["a"]["certified"]) == (70, 60, [0, 1, 2], True)
    assert not got["b"]["certified"] and got["b"]["illegal"] == got["b"]["broken"] == 1 and got["c"]["missing"] == 1
    checker = turns.replayed(path, g.edges, g.turns, 3).select("route", "cost", "length")
    both = {r["route"]: r["category"] for r in search.reconciled(rows, checker).collect()}
    assert both["a"] == "FEASIBLE" and both["c"] == "CHECKER_MISMATCH"
    assert [tuple(r)[1:] for r in turns.states(path.where("route = 'a'"), g.edges).orderBy("pos").select("route", "edge_id", "mask", "seen").collect()] == [("w", 1, 1), ("l", 2, 3), ("k", 4, 7)]


def brute(edges, pairs, start, order):
    """Dijkstra over (edge, visited mask), in plain Python."""
    mask = {e[0]: e[5] for e in edges}
    cost = {e[0]: e[3] for e in edges}
    out: dict = {}
    for a, b, c in pairs:
        out.setdefault(a, []).append((b, c))
    target = sum(1 << b for b in order)

    def follow(seen, m):
        got = list(seen)
        got += [b for b in range(8) if m >> b & 1 and b not in seen]
        return got if got == order[: len(got)] and not m & ~target else None

    first = follow([], mask[start] | 1 << order[0])
    if first is None:
        return None
    heap, best = [(cost[start], start, tuple(first))], {}
    while heap:
        c, e, seen = heapq.heappop(heap)
        if list(seen) == order:
            return c
        if best.get((e, seen), 1 << 60) <= c:
            continue
        best[e, seen] = c
        for b, t in out.get(e, []):
            nxt = follow(list(seen), mask[b])
            if nxt is not None:
                heapq.heappush(heap, (c + t + cost[b], b, tuple(nxt)))
    return None


@pytest.mark.parametrize("seed", range(2))
def test_routes_against_brute_force(spark, seed):
    r = random.Random(seed)
    n = 24
    rows = [(f"e{i:02d}", i, i, r.randint(1, 50), 1, r.choice([0, 0, 0, 0, 0, 1, 2, 4, 6, 8]), r.random(), r.random()) for i in range(n)]
    pairs = [(f"e{r.randrange(n):02d}", f"e{r.randrange(n):02d}", r.randint(0, 9)) for _ in range(80)]
    g = search.RoadGraph(spark.createDataFrame(rows, EDGES), spark.createDataFrame(pairs, TURNS))
    start = next(e[0] for e in rows if e[5] == 0)
    bounds = {b["bit"]: tuple(b)[1:] for b in g.bounds(4).collect()}
    for order in ([0, 1, 2], [3, 2, 1]):
        want = brute(rows, pairs, start, order)
        got = search.FixedOrder(g, start, order, bounds=bounds, units=1e9 if seed else 1.0) if seed else search.FixedOrder(g, start, order)
        assert (got.goal_label() or (None,))[0] == want
    assert (search.FixedOrder(g, start, [0, 1], beam=5).goal_label() or (1 << 60,))[0] >= (brute(rows, pairs, start, [0, 1]) or 0)
    reach = {x["edge_id"]: x["hops"] for x in search.reachable(g.turns, spark.createDataFrame([(start,)], "edge_id string")).collect()}
    seen, frontier, h = {start: 0}, [start], 0
    while frontier:
        h += 1
        frontier = sorted({b for a, b, _ in pairs if a in frontier} - seen.keys())
        seen |= dict.fromkeys(frontier, h)
    assert reach == seen
    w = search.witnesses(search.reachable(g.turns, spark.createDataFrame([(start,)], "edge_id string"), gates=g.edges, all_bits=1), g.edges, 4)
    assert w.where("bit = 0").first()["verdict"] == ("REACHABLE" if any(e in seen and m & 1 for e, *_, m, _, _ in rows) else "UNREACHABLE")
    fwd = search.witnesses(search.reachable(g.turns, spark.createDataFrame([(start,)], "edge_id string")), g.edges, 4)
    assert search.connected_pairs(fwd, fwd).count() == 12


def test_continuations_and_resolution(spark):
    e = spark.createDataFrame([("a@0", "a", 0, 1, 2), ("a@1", "a", 1, 2, 3), ("b@0", "b", 0, 3, 4), ("c@0", "c", 0, 4, 3), ("d@0", "d", 0, 4, 5), ("f@0", "f", 0, 5, 6), ("g@0", "g", 0, 5, 7)], "edge_id string, parent string, ordinal int, from_node bigint, to_node bigint")
    t = spark.createDataFrame([("x", "g@0", 1)], TURNS)
    got = {tuple(x) for x in turns.continuations(e, t).collect()}
    assert got == {("a@1", "b@0", 0), ("b@0", "d@0", 0), ("d@0", "f@0", 0)}
    assert turns.every_turn(t, turns.continuations(e, t)).count() == 4
    segments = spark.createDataFrame([(0, 0, "10/0/0/1/2"), (0, 1, "10/1/0/2/3"), (1, 0, "11/0/0/3/4")], "ebn int, ordinal int, edge_id string")
    raw = spark.createDataFrame([(0, 1, 200, "allowed"), (1, 0, 1, "prohibited"), (1, 9, 1, "allowed")], "in_ebn int, out_ebn int, turn_cost bigint, status string")
    r = turns.resolved(raw, segments)
    assert turns.legality(r).first() == (3, 1, 1) and ("10/1/0/2/3", "11/0/0/3/4", 200) in {tuple(x) for x in turns.allowed(r).collect()}
    with pytest.raises(Exception, match="not allowed"):
        turns.allowed(r, guard=True).collect()
    keys = spark.createDataFrame([("a@1",), ("b@0",)], "edge_id string")
    inner = turns.induced(e, turns.continuations(e, t), keys)
    assert inner[0].count() == 2 and inner[1].count() == 1


def test_outcome_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0, 1], "FEASIBLE", 7, 60, 2, None, "m1"), ("b", [0, 1], "FEASIBLE", 9, 50, 2, None, "m1"), ("c", [0, 2], "UNREACHABLE", None, None, 1, "zero", "m2"), ("d", [0, 2], "TIMEOUT", None, None, 2, "late", "m2")], search.OUTCOMES + ", model string")
    rows = rows.withColumn("terminal", rows["order"][1])
    assert [tuple(r)[:4] for r in outcomes.finishes(rows).collect()] == [(1, "a", 7, 60)]
    assert outcomes.best_failed(rows, "model").first()["route"] == "c" and outcomes.longest(rows, "model").where("model = 'm2'").first()["route"] == "d"
    assert [r["gap"] for r in outcomes.ranked_terminals(rows).collect()] == [0]
    assert outcomes.unknown_keys(rows, "category", ("FEASIBLE", "TIMEOUT")).collect()[0][0] == "UNREACHABLE"
    with pytest.raises(Exception, match="unknown category"):
        outcomes.histogram(rows, "model").collect()
    outcomes.write_outcomes(rows, f"{tmp_path}/o", partition_by="model")
    outcomes.write_outcomes(rows.where("model = 'm2'"), f"{tmp_path}/o", partition_by="model")
    assert spark.read.option("header", True).csv(f"{tmp_path}/o").count() == 4
    assert outcomes.first_per(rows, "model", "route", 1).count() == 2 and outcomes.any_row(rows)
