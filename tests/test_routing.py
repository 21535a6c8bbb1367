"""Routing against Dijkstra, on literal, random and whole networks."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.operators import routing as R
from terravia.plans import network
from tests.conftest import SF, SMALL

EDGES = "eid string, src string, dst string, class string, len_m long"
TRIPS = "trip string, start string, goal string, shape string"


def dijkstra(rows, source, weights, factors=None):
    """node: (cost, edge before, node before), over edges (eid, src, dst, class, len_m) travelled both ways."""
    out, best, heap = {}, {}, [(0.0, source, None, None)]
    for eid, a, b, kind, metres in rows:
        c = metres * weights[kind] * (factors or {}).get(eid, 1.0)
        out.setdefault(a, []).append((b, c, eid))
        out.setdefault(b, []).append((a, c, eid))
    if source not in out:
        return {}
    while heap:
        cost, node, eid, before = heapq.heappop(heap)
        if node not in best:
            best[node] = (cost, eid, before)
            for b, c, e in out[node]:
                heapq.heappush(heap, (cost + c, b, e, node))
    return best


def random_network(seed, crossings=12, links=20, longest=6):
    """Crossings joined by chains, some parallel, some closed, a ring apart and a part out of reach."""
    r = random.Random(seed)
    rows = []

    def chain(a, b, n):
        nodes = [a, *(f"{len(rows)}.{i}" for i in range(n - 1)), b]
        for u, v in zip(nodes, nodes[1:], strict=False):
            u, v = (u, v) if r.random() < 0.5 else (v, u)
            rows.append((f"e{len(rows)}", u, v, r.choice(["road", "4wd", "trail"]), r.randrange(1, 100)))

    for _ in range(links):
        chain(f"c{r.randrange(crossings)}", f"c{r.randrange(crossings)}", r.randrange(1, longest + 1))
    chain("ring", "ring", 5)
    chain("x", "y", 3)
    return rows


def way_cost(rows, eids, weights, factors=None):
    by = {e: w * weights[k] * (factors or {}).get(e, 1.0) for e, _, _, k, w in rows}
    return sum(by[e] for e in eids)


def checked_way(rows, legs, start, goal):
    """The edges of a leg, which hang together from start to goal."""
    by, at = {r[0]: {r[1], r[2]} for r in rows}, start
    for nth, r in enumerate(sorted(legs, key=lambda r: r.nth), 1):
        assert r.nth == nth and r.src == at and {r.src, r.dst} == by[r.eid]
        at = r.dst
    assert at == goal
    return [r.eid for r in sorted(legs, key=lambda r: r.nth)]


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_ways_of_random_networks(spark, seed):
    rows = random_network(seed)
    edges = spark.createDataFrame(rows, EDGES)
    for weights in (R.WEIGHTS["4wd_day"],):
        want = dijkstra(rows, "c0", weights)
        got = {r.node: r.cost for r in R.distances(edges, "c0", weights).collect()}
        assert got == pytest.approx({n: c for n, (c, _, _) in want.items()})
    nodes = sorted({n for r in rows for n in r[1:3]})
    picked = random.Random(seed).sample(nodes, 8)
    wanted = [(f"t{i}", picked[i], picked[-1 - i]) for i in range(4)] + [("same", "c0", "c0"), ("away", "c0", "x"), ("none", "c0", "nowhere"), ("from", "nowhere", "c0")]
    legs = R.cheapest_ways(edges, spark.createDataFrame(wanted, "trip string, start string, goal string"), R.WEIGHTS["outing"]).collect()
    for trip, start, goal in wanted:
        mine, best = [r for r in legs if r.trip == trip], dijkstra(rows, start, R.WEIGHTS["outing"])
        if goal not in best:
            assert not mine
        else:
            assert way_cost(rows, checked_way(rows, mine, start, goal), R.WEIGHTS["outing"]) == pytest.approx(best[goal][0])


def test_the_cheaper_of_parallel_edges(spark):
    rows = [("1", "a", "b", "road", 10), ("2", "a", "b", "trail", 10), ("3", "b", "c", "trail", 5), ("4", "a", "c", "road", 6), ("5", "x", "y", "trail", 1), ("6", "a", "a", "trail", 1)]
    edges = spark.createDataFrame(rows, EDGES)
    weights = {"trail": 1.0, "road": 3.0, "4wd": 1.5}
    assert {r.node: r.cost for r in R.distances(edges, "c", weights).collect()} == {"c": 0.0, "b": 5.0, "a": 15.0}
    legs = R.cheapest_ways(edges, spark.createDataFrame([("t", "c", "a")], "trip string, start string, goal string"), weights)
    assert [(r.nth, r.eid) for r in legs.orderBy("nth").collect()] == [(1, "3"), (2, "2")]
    with pytest.raises(ValueError, match="no weight"):
        R.distances(edges, "c", {"trail": 1.0})


def test_a_chain_of_thousands_of_hops(spark):
    """5,000 edges in a row are one step, found in some ten rounds."""
    n = 5000
    chain = spark.range(n).select(F.col("id").cast("string").alias("eid"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("dst"), F.lit("trail").alias("class"), F.lit(1).alias("len_m"))
    ends = spark.createDataFrame([("n0",), (f"n{n}",)], "node string")
    net = R.contract(chain, ends)
    assert net.steps.count() == 2 and net.steps.agg(F.min("edges")).first()[0] == n
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    wanted = spark.createDataFrame([("t", "n0", f"n{n}")], "trip string, start string, goal string")
    legs = R.cheapest_ways(chain, wanted).orderBy("nth").collect()
    spark.sparkContext.setJobGroup("", "")
    assert [r.eid for r in legs] == [str(i) for i in range(n)]
    assert len(jobs.getJobIdsForGroup("chain")) < 400, "rounds are in proportion to the digits of the length, not to the length"


def test_settled_vertices_are_not_read_again(spark, monkeypatch):
    """A long line of crossings (each has a stub), in buckets of one step's cost: what a search joins stays small."""
    n = 14
    rows = [(f"e{i}", f"n{i}", f"n{i + 1}", "trail", 1) for i in range(n)] + [(f"s{i}", f"n{i}", f"stub{i}", "trail", 1) for i in range(n)]
    edges = spark.createDataFrame(rows, EDGES)
    seen = []
    put = R.Scratch.put
    monkeypatch.setattr(R.Scratch, "put", lambda self, name, df: seen.append((name, df)) or put(self, name, df))
    read = []
    monkeypatch.setattr(R.Scratch, "appended", lambda self, name, like, f=R.Scratch.appended: read.append(name) or f(self, name, like))
    reached = R.search(R.contract(edges, edges.select(F.col("src").alias("node")).union(edges.select("dst"))), spark.createDataFrame([("t", "n0")], "trip string, node string"))
    assert {r.node: r.cost for r in reached.collect()}[f"n{n}"] == float(n)
    assert read.count("settled") == 1, "only as the result"
    # early exit
    goals = spark.createDataFrame([("t", "n3")], "trip string, node string")
    some = R.search(R.contract(edges, edges.select(F.col("src").alias("node")).union(edges.select("dst"))), spark.createDataFrame([("t", "n0")], "trip string, node string"), goals=goals)
    assert some.count() < 20


def brute_trip(rows, start, goal, shape):
    """(reachable, shape, shared, share_4wd, legs' cost) by Dijkstra; shares of ties may differ, so networks have none."""
    outing, rough = R.WEIGHTS["outing"], R.WEIGHTS["4wd_day"]
    best = dijkstra(rows, start, outing)
    if goal not in best:
        return False, None, None, None, None

    def way(found, end):
        eids = []
        while found[end][1] is not None:
            eids.append(found[end][1])
            end = found[end][2]
        return eids[::-1]

    size = {r[0]: r[4] for r in rows}
    kind = {r[0]: r[3] for r in rows}
    out = way(best, goal)
    shared = share4 = None
    metres = 2 * sum(size[e] for e in out)
    became = "out_and_back"
    if shape == "loop":
        back = way(dijkstra(rows, goal, outing, dict.fromkeys(out, 4.0)), start)
        shared = len(set(out) & set(back)) / len(out) if out else 0.0
        if shared <= 0.35:
            became, metres = "loop", sum(size[e] for e in out + back)
    elif shape == "4wd":
        own = way(dijkstra(rows, start, rough), goal)
        total = sum(size[e] for e in own)
        share4 = sum(size[e] for e in own if kind[e] == "4wd") / total if total else None
        if (share4 or 0) >= 0.4:
            became, metres = "4wd", 2 * total
    return True, became, shared, share4, metres


def uneven(rows, seed):
    """The same network with lengths of many digits, so that no two ways cost the same."""
    r = random.Random(seed)
    return [(e, a, b, k, r.randrange(10**6, 10**8)) for e, a, b, k, _ in rows]


@pytest.mark.parametrize("seed", [4])
def test_trips_of_random_networks(spark, seed):
    rows = uneven(random_network(seed, crossings=8, links=16), seed)
    nodes = sorted({n for r in rows for n in r[1:3]})
    r = random.Random(seed)
    wanted = [(f"t{i}", *r.sample(nodes, 2), R.SHAPES[i % 3]) for i in range(18)] + [(f"s{k}", "c0", "c0", k) for k in R.SHAPES] + [("n", "c0", "nowhere", "loop"), ("m", "nowhere", "c0", "4wd")]
    summary, legs = R.trips(spark.createDataFrame(rows, EDGES), spark.createDataFrame(wanted, TRIPS))
    told, legs = {x.trip: x for x in summary.collect()}, legs.collect()
    assert len(told) == len(wanted)
    shapes = set()
    for trip, start, goal, shape in wanted:
        want, x = brute_trip(rows, start, goal, shape), told[trip]
        shapes.add(want[1])
        assert (x.reachable, x["shape"]) == want[:2], (trip, start, goal, shape)
        assert (x.shared, x.share_4wd, x.length_m) == pytest.approx(want[2:]) if want[0] else (x.shared, x.share_4wd, x.length_m) == (None, None, None)
        out, back = ([y for y in legs if y.trip == trip and y.leg == k] for k in (0, 1))
        if not want[0]:
            assert not out and not back
            continue
        there, home = checked_way(rows, out, start, goal), checked_way(rows, back, goal, start)
        size = {e[0]: e[4] for e in rows}
        assert sum(size[e] for e in there + home) == pytest.approx(want[4])
        assert want[1] == "loop" or home == there[::-1]
    assert {None, *R.SHAPES} <= shapes


def test_trip_shapes(spark):
    ring = [("1", "a", "b", "trail", 10), ("2", "b", "c", "trail", 10), ("3", "c", "d", "trail", 11), ("4", "d", "a", "trail", 11)]
    line = [("5", "p", "q", "4wd", 10), ("6", "q", "r", "road", 10)]
    # the way out is short; the way back shares two of its three edges but few of its own
    lobe = [("7", "u", "v", "trail", 1), ("8", "v", "w", "trail", 1), ("9", "w", "z", "trail", 10)] + [(f"l{i}", f"k{i}" if i else "w", f"k{i + 1}" if i < 9 else "z", "trail", 2) for i in range(10)]
    wanted = [("ring", "a", "c", "loop"), ("line", "p", "r", "4wd"), ("plain", "p", "r", "out_and_back"), ("no loop", "p", "r", "loop"), ("lobe", "u", "z", "loop"), ("apart", "a", "p", "loop")]
    summary, legs = R.trips(spark.createDataFrame(ring + line + lobe, EDGES), spark.createDataFrame(wanted, TRIPS))
    shape = {r.trip: (r.reachable, r["shape"], r.shared) for r in summary.collect()}
    assert shape == {"ring": (True, "loop", 0.0), "line": (True, "4wd", None), "plain": (True, "out_and_back", None), "no loop": (True, "out_and_back", 1.0), "lobe": (True, "out_and_back", 2 / 3), "apart": (False, None, None)}
    way = lambda t: [(r.leg, r.nth, r.eid) for r in legs.where(F.col("trip") == t).orderBy("leg", "nth").collect()]
    assert way("ring") == [(0, 1, "1"), (0, 2, "2"), (1, 1, "3"), (1, 2, "4")]
    assert way("line") == [(0, 1, "5"), (0, 2, "6"), (1, 1, "6"), (1, 2, "5")]
    assert way("apart") == []


def test_budget_keeps_every_trip(spark):
    lengths = spark.createDataFrame([(f"t{i}", float(x)) for i, x in enumerate([300_000, 900_000, 20, 0, 1_000_000])] + [("none", None)], "trip string, length_m double")
    spacing, sized = R.within_budget(lengths, 15.0, most=3000)
    got = {r.trip: r.n_points for r in sized.collect()}
    assert len(got) == 6 and got["none"] is None and got["t3"] == got["t2"] == 2
    assert sum(n for n in got.values() if n) <= 3000 and spacing > 15.0
    same, sized = R.within_budget(lengths, 15.0, most=20_000)
    assert same == 15.0 and max(r.n_points or 0 for r in sized.collect()) == R.MOST_TRIP_POINTS


def test_whole_network_queries(spark):
    rows = [(r.eid, r.src, r.dst, r["class"], r.len_m) for r in fx.edges(spark, SMALL).collect()]
    want = {n: round(c, 6) for n, (c, _, _) in dijkstra(rows, "S1", network.OUTING).items()}
    assert {r.node: r.cost for r in network.shortest_paths(spark, SMALL).collect()} == pytest.approx(want)
    last = network.farthest(spark, SMALL)
    legs = network.shortest_path_edges(spark, SMALL).collect()
    assert way_cost(rows, checked_way(rows, legs, "S1", last), network.OUTING) == pytest.approx(want[last])
    wanted = network.nation_trips(spark, SMALL).collect()
    told = {r.trip: r for r in network.trip_shape(spark, SMALL).collect()}
    legs = network.trip_legs(spark, SMALL).collect()
    size, kind = {r[0]: r[4] for r in rows}, {r[0]: r[3] for r in rows}
    for t in wanted:
        x, best = told[t.trip], dijkstra(rows, t.start, network.OUTING)
        assert x.reachable == (t.goal in best)
        if not x.reachable:
            continue
        out, back = (checked_way(rows, [y for y in legs if y.trip == t.trip and y.leg == k], *ends) for k, ends in ((0, (t.start, t.goal)), (1, (t.goal, t.start))))
        weights = R.WEIGHTS["4wd_day"] if x["shape"] == "4wd" else network.OUTING
        assert way_cost(rows, out, weights) == pytest.approx(dijkstra(rows, t.start, weights)[t.goal][0])
        assert x.length_m == sum(size[e] for e in out + back)
        if x["shape"] == "loop":
            dear = dict.fromkeys(out, 4.0)
            assert way_cost(rows, back, weights, dear) == pytest.approx(dijkstra(rows, t.goal, weights, dear)[t.start][0])
            assert x.shared == pytest.approx(len(set(out) & set(back)) / len(out) if out else 0, abs=1e-6) and x.shared <= 0.35
        else:
            assert back == out[::-1]
        if x["shape"] == "4wd":
            assert x.share_4wd == pytest.approx(sum(size[e] for e in out if kind[e] == "4wd") / sum(size[e] for e in out), abs=1e-6)


def test_a_search_follows_nothing_dearer_than_its_goals(spark):
    """All vertices lie in one bucket of cost; a goal that is no vertex is not looked for everywhere."""
    rows = [(f"{i}-{j}", f"s{i}", f"p{j}", "trail", 1 if i + j < 2 else 50 + i + j) for i in range(5) for j in range(5)]
    edges = spark.createDataFrame(rows, EDGES)
    starts = spark.createDataFrame([("near", "s0"), ("none", "s0")], "trip string, node string")
    goals = spark.createDataFrame([("near", "s1"), ("none", "nowhere")], "trip string, node string")
    net = R.contract(edges, starts.union(goals).select("node"))
    got = {(r.trip, r.node): r.cost for r in R.search(net, starts, None, goals).collect()}
    assert got == {("near", "s0"): 0.0, ("near", "p0"): 1.0, ("near", "p1"): 1.0, ("near", "s1"): 2.0}
    last = R.farthest_way(edges, "s0").orderBy("nth").collect()
    costs = {n: c for n, (c, _, _) in dijkstra(rows, "s0", {"trail": 1.0}).items()}
    end = max(costs, key=lambda n: (costs[n], n))
    assert way_cost(rows, checked_way(rows, last, "s0", end), {"trail": 1.0}) == costs[end]


def test_goals_out_of_reach_are_told_for_all_trips_together(spark, monkeypatch):
    """Two parts of 24 vertices, and 30 trips from one to the other: no table has a row for each trip and vertex."""
    rows = [(f"{part}{i}-{j}", f"{part}s{i}", f"{part}p{j}", "trail", 10 + i + 7 * j) for part in "ab" for i in range(12) for j in range(12)]
    edges = spark.createDataFrame(rows, EDGES)
    wanted = [(f"t{i}", f"as{i % 12}", f"bp{(i * 5) % 12}", R.SHAPES[i % 3]) for i in range(30)] + [("near", "as1", "as4", "loop"), ("same", "as2", "as2", "loop"), ("none", "as2", "nowhere", "loop")]
    most = []
    put = R.Scratch.put

    def counted(self, name, df):
        out = put(self, name, df)
        if name not in ("edges", "steps", "seen", "touch"):
            most.append((out.count(), name))
        return out

    monkeypatch.setattr(R.Scratch, "put", counted)
    summary, _ = R.trips(edges, spark.createDataFrame(wanted, TRIPS))
    assert sorted(r.trip for r in summary.where("reachable").collect()) == ["near", "same"]
    assert max(most)[0] <= 2 * 24 + 2 * 24, max(most)


def one_ended(*args, **kwargs):
    raise AssertionError("a trip is searched from both its ends")


def test_loop_share_is_searched_from_both_ends(spark, monkeypatch):
    monkeypatch.setattr(R, "search", one_ended)
    share = {r.trip: r.share for r in network.loop_share(spark, SMALL).collect()}
    known = {n for r in fx.edges(spark, SMALL).select("src", "dst").collect() for n in r}
    wanted = network.nation_trips(spark, SMALL).collect()
    assert set(share) == {t.trip for t in wanted}
    for t in wanted:
        assert (share[t.trip] is None) == (t.goal not in known or t.start not in known)
        assert share[t.trip] is None or 0 <= share[t.trip] <= 1 and (t.start != t.goal or share[t.trip] == 0)


def test_trip_legs_are_searched_from_both_ends(spark, monkeypatch):
    monkeypatch.setattr(R, "search", one_ended)
    by = {r.eid: {r.src, r.dst} for r in fx.edges(spark, SF).collect()}
    legs = network.trip_legs(spark, SF).collect()
    wanted = {t.trip: t for t in network.nation_trips(spark, SF).collect()}
    assert legs
    for trip, leg in {(r.trip, r.leg) for r in legs}:
        at, end = (wanted[trip].start, wanted[trip].goal)[:: -1 if leg else 1]
        for r in sorted((r for r in legs if (r.trip, r.leg) == (trip, leg)), key=lambda r: r.nth):
            assert r.src == at and {r.src, r.dst} == by[r.eid]
            at = r.dst
        assert at == end
