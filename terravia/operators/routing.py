"""Cheapest ways in large networks, for many searches at once.

A road network is mostly chains: points of a way that touch two edges. `contract` replaces
each chain by one step, in as many rounds as the longest one's length has binary digits
(every edge learns where its chain ends by pointer doubling), whatever the weights, since a
step keeps the metres of each class. `search` settles vertices bucket by bucket of cost, for all
searches together: in a bucket only the vertices that became cheaper are joined to their steps,
candidates are merged with what is tentative, and a bucket that no longer changes is appended to the
result and never read again in the search. A step costs no more than a bucket is wide and may be gone either
way, so a settled vertex can only be met from its own bucket or the next, and one bucket is kept
aside to tell. A search ends once its goals are settled. `ways` follows all goals back at once,
again by pointer doubling. What reaches the driver are counts and costs of buckets.

A search from one vertex to another is run from both ends at once (`between`), cheapest vertices first, and ends once
no two vertices that are still to be gone on from can be on a cheaper way than the one that was found. Whether there is a way at all is
told before, for all of them together (`linked`): each vertex is gone on from once, for whichever end met it first.

Ties go to the vertex that was found first, of those found in one round to the smaller previous vertex, then step; from both
ends to the way of fewer steps as they were found, then to the smaller vertex.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravia.shared import Scratch, kept

#: The cost of a metre by purpose and class, the share of common edges that a loop may have, how much dearer
#: the edges of the way out are on the way back, the share of 4wd that makes a 4wd trip.
WEIGHTS = {
    "outing": {"trail": 0.6, "4wd": 0.7, "road": 1.5},
    "approach": {"trail": 1.3, "4wd": 1.0, "road": 0.7},
    "4wd_day": {"trail": 2.5, "4wd": 0.5, "road": 1.0},
}
MOST_SHARED, TURNED_PENALTY, LEAST_4WD = 0.35, 4.0, 0.4
#: Points of all trips, points of a trip, metres between points at least, printed pixels between them, and by how much more than in proportion a spacing grows that is too fine.
MOST_POINTS, MOST_TRIP_POINTS, LEAST_SPACING_M, SPACING_PX, COARSER = 18_000, 4_200, 15.0, 1.5, 1.02
SHAPES = ("out_and_back", "loop", "4wd")


def _metres(classes: list[str]) -> list[str]:
    return [f"m_{i}" for i in range(len(classes))]


class Network:
    """A network of which chains are contracted.

    arcs: eid, src, dst, last, left: each edge in each direction, the arc that its chain ends
    with, and how many edges the chain still has, its own counted. steps: src, dst, via (the chain's last arc),
    chain (the same in both directions), edges, and a column of metres for each class.
    """

    def __init__(self, arcs: DataFrame, steps: DataFrame, classes: list[str], plain: bool = False):
        """plain: each edge is a step, and has its class and len_m besides."""
        self.arcs, self.steps, self.classes, self.plain = arcs, steps, classes, plain

    def metres(self) -> Column:
        if self.plain:
            return F.col("len_m")
        return sum((F.col(m) for m in _metres(self.classes)), F.lit(0.0))

    def metres_of(self, kind: str) -> Column:
        return F.col(_metres(self.classes)[self.classes.index(kind)]) if kind in self.classes else F.lit(0.0)

    def costs(self, weights: dict[str, float] | None) -> Column:
        """Of a step; a metre of a class that has no weight costs nothing that is defined, so there must be one for each."""
        if weights is None:
            return self.metres()
        if missing := set(self.classes) - set(weights):
            raise ValueError(f"no weight for {sorted(missing)}")
        if self.plain and self.classes:
            return F.col("len_m") * reduce(lambda rest, c: F.when(F.col("class") == c, F.lit(weights[c])).otherwise(rest), self.classes[1:], F.lit(weights[self.classes[0]]))
        return sum((F.col(m) * weights[c] for m, c in zip(_metres(self.classes), self.classes, strict=True)), F.lit(0.0))


def _read_once(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """The edges between different vertices, written once as everything below reads them several times, and their classes."""
    once = scratch.put("edges", edges.where("src <> dst").select("eid", "src", "dst", "class", F.col("len_m").cast("double").alias("len_m")))
    return once, sorted(r["class"] for r in once.select("class").distinct().collect())


def uncontracted(edges: DataFrame) -> Network:
    """The network with each edge a step, for searches that want every vertex."""
    return _each_a_step(*_read_once(edges, Scratch(edges.sparkSession, "network")))


def _each_a_step(edges: DataFrame, classes: list[str]) -> Network:
    metres = [F.when(F.col("class") == c, F.col("len_m")).otherwise(0.0).alias(m) for m, c in zip(_metres(classes), classes, strict=True)]
    one = lambda sign, a, b: edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.concat("eid", F.lit(sign)).alias("via"), F.col("eid").alias("chain"), F.lit(1).alias("edges"), "class", "len_m", *metres)
    steps = one("+", "src", "dst").unionByName(one("-", "dst", "src"))
    return Network(steps.select(F.col("chain").alias("eid"), "src", "dst", F.col("via").alias("last"), F.lit(1).alias("left")), steps, classes, True)


def contract(edges: DataFrame, keep: DataFrame) -> Network:
    """The network of edges (eid, src, dst, class, len_m) travelled both ways; vertices in keep (node) are never inside a chain.

    Edges from a vertex to itself and rings that no vertex of keep and no crossing touches are on no cheapest way.
    """
    scratch = Scratch(edges.sparkSession, "contract")
    edges, classes = _read_once(edges, scratch)
    arc = lambda sign, a, b: edges.select(F.concat("eid", F.lit(sign)).alias("arc"), "eid", F.col(a).alias("src"), F.col(b).alias("dst"), "class", "len_m")
    arcs = arc("+", "src", "dst").unionByName(arc("-", "dst", "src"))
    inner = arcs.groupBy("src").agg(F.count("*").alias("n")).where("n = 2").select(F.col("src").alias("node")).join(keep.select("node").distinct(), "node", "left_anti")
    inner = scratch.put("inner", inner)
    if inner.isEmpty():
        return _each_a_step(edges, classes)
    out = arcs.join(inner, arcs["src"] == inner["node"]).select(F.col("src").alias("at"), F.col("arc").alias("next"), F.col("eid").alias("next_eid"))
    out = scratch.put("out", out)
    metres = [F.when(F.col("class") == c, F.col("len_m")).otherwise(0.0).alias(m) for m, c in zip(_metres(classes), classes, strict=True)]
    first = arcs.join(out, (arcs["dst"] == out["at"]) & (arcs["eid"] != out["next_eid"]), "left")
    own = ["arc", "eid", "src", "dst"]
    state = first.select(*own, F.col("dst").alias("end"), "next", F.col("arc").alias("last"), F.lit(1).alias("left"), *metres)
    open_ = scratch.put("open", state)
    scratch.append("done", open_.where("next IS NULL"))
    open_ = scratch.put("open", open_.where("next IS NOT NULL"))
    # those whose chain is not followed to its end yet are joined to all: after k rounds each knows 2^k edges ahead
    for _ in range(max(1, open_.count()).bit_length() + 1):
        if open_.isEmpty():
            break
        ahead = scratch.appended("done", state).unionByName(open_).select(*(F.col(c).alias(f"a_{c}") for c in ["arc", "end", "next", "last", "left", *_metres(classes)]))
        met = open_.join(ahead, F.col("next") == F.col("a_arc"))
        sums = [(F.col(c) + F.col(f"a_{c}")).alias(c) for c in ["left", *_metres(classes)]]
        further = met.select(*own, F.col("a_end").alias("end"), F.col("a_next").alias("next"), F.col("a_last").alias("last"), *sums)
        further = scratch.put("further", further)
        scratch.append("done", further.where("next IS NULL"))
        open_ = scratch.put("open", further.where("next IS NOT NULL"))
    ended = scratch.appended("done", state)
    heads = ended.join(inner, ended["src"] == inner["node"], "left_anti").where("src <> end")
    last_eid = F.expr("substring(last, 1, length(last) - 1)")
    steps = heads.select("src", F.col("end").alias("dst"), F.col("last").alias("via"), F.least("eid", last_eid).alias("chain"), F.col("left").alias("edges"), *_metres(classes))
    scratch.append("steps", steps)
    scratch.clear()
    return Network(ended.select("eid", "src", "dst", "last", "left"), scratch.appended("steps", steps), classes)


def _paid(steps: DataFrame, penalties: DataFrame | None) -> DataFrame:
    """steps (trip, chain, c), with c as the trip pays it."""
    if penalties is None:
        return steps
    factor = penalties.withColumnsRenamed({"trip": "p_trip", "chain": "p_chain"})
    met = steps.join(factor, (F.col("trip") == F.col("p_trip")) & (F.col("chain") == F.col("p_chain")), "left")
    return met.withColumn("c", F.col("c") * F.coalesce("factor", F.lit(1.0))).drop("p_trip", "p_chain", "factor")


def _largest(penalties: DataFrame | None) -> DataFrame | None:
    return None if penalties is None else penalties.groupBy("trip", "chain").agg(F.max("factor").alias("factor"))


def search(net: Network, starts: DataFrame, weights: dict[str, float] | None = None, goals: DataFrame | None = None, penalties: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """trip, node, cost, prev, hops: the cheapest way from each search's start to the vertices within reach, or until its goals are settled.

    Once all goals of a search have been met, nothing dearer than the dearest of them is followed; a goal that is no vertex of the network is not waited for.
    starts, goals: trip, node. penalties: trip, chain, factor. width: of a bucket of cost; at least the dearest step's.
    """
    spark = starts.sparkSession
    scratch = Scratch(spark, "search")
    costed = scratch.put("steps", net.steps.select("src", "dst", *(["chain"] if penalties is not None else []), net.costs(weights).alias("c")))
    dearest = costed.agg(F.max("c")).first()[0] or 0.0
    if penalties is not None:
        penalties = scratch.put("penalties", _largest(penalties))
        dearest *= penalties.agg(F.greatest(F.lit(1.0), F.max("factor"))).first()[0] or 1.0
    # a little wider, so that a rounded sum cannot skip a bucket
    width = max(width or 0.0, dearest * (1 + 1e-9)) or 1.0
    first = starts.select("trip", "node", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("prev"), F.lit(0).alias("hops")).distinct()
    tentative = scratch.put("tentative", first.withColumn("fresh", F.lit(1)))
    empty = first.where("false")
    left = bounds = None
    if goals is not None:
        goals = scratch.put("goals", goals.select("trip", "node").distinct())
        there = costed.join(goals.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("node")).union(tentative.select("node")).distinct()
        left = scratch.put("left", goals.join(there, "node", "left_semi").select("trip", "node"))
    recent = empty.select("trip", "node")
    scratch.append("settled", empty)

    def within(rows: DataFrame) -> DataFrame:
        """rows that may still be on a way to a goal: trip, cost."""
        if bounds is None:
            return rows
        return rows.join(bounds, "trip").where("bound IS NULL OR cost <= bound").drop("bound")

    def bounded() -> DataFrame | None:
        """trip, bound: what the dearest goal costs at most, null while one is not met; trips without goals to settle are gone."""
        if left is None:
            return None
        met = left.join(tentative.select("trip", "node", "cost"), ["trip", "node"], "left").groupBy("trip")
        return scratch.put("bounds", met.agg(F.when(F.count("cost") == F.count("*"), F.max("cost")).alias("bound")))

    def lowest() -> tuple[float | None, float | None]:
        """What the cheapest tentative vertex costs, and the cheapest of those that are to be gone on from."""
        return tuple(within(tentative).agg(F.min("cost"), F.min(F.when(F.col("fresh") == 1, F.col("cost")))).first())

    while left is None or not left.isEmpty():
        bounds = bounded()
        low, fresh = lowest()
        if low is None:
            break
        limit = (low // width + 1) * width
        while fresh is not None and fresh < limit:
            front = within(tentative.where((F.col("cost") < limit) & (F.col("fresh") == 1)))
            moved = _paid(front.join(costed, front["node"] == costed["src"]), penalties)
            made = within(moved.select("trip", F.col("dst").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.col("src").alias("prev"), (F.col("hops") + 1).alias("hops"), F.lit(1).alias("fresh")))
            # settled vertices are met again only from the bucket before
            made = made.join(recent, ["trip", "node"], "left_anti")
            gone = (F.col("cost") < limit) & (F.col("fresh") == 1)
            both = within(tentative).withColumn("fresh", F.when(gone, 0).otherwise(F.col("fresh"))).unionByName(made)
            # `old` goes before what is found again at the same cost
            order = F.struct("cost", F.when(F.col("prev").isNull(), 0).otherwise(F.col("fresh")).alias("old"), "prev", "hops", "fresh")
            tentative = scratch.put("tentative", both.groupBy("trip", "node").agg(F.min(order).alias("m")).select("trip", "node", *(f"m.{c}" for c in ("cost", "prev", "hops", "fresh"))))
            bounds = bounded()
            low, fresh = lowest()
        settled = scratch.put("bucket", within(tentative.where(F.col("cost") < limit)).drop("fresh").select("trip", "node", "cost", "prev", "hops"))
        scratch.append("settled", settled)
        recent = settled.select("trip", "node")
        if left is not None:
            left = scratch.put("left", left.join(recent, ["trip", "node"], "left_anti"))
        tentative = scratch.put("tentative", tentative.where(F.col("cost") >= limit))
    scratch.clear()
    return scratch.appended("settled", empty)


def named(net: Network, way: DataFrame, weights: dict[str, float] | None = None, penalties: DataFrame | None = None) -> DataFrame:
    """way (rows of a search) with via and chain, and the step's edges, metres (m) and metres of 4wd (m4): of parallel steps the cheapest, then the smallest."""
    of = net.steps.select(F.col("src").alias("prev"), F.col("dst").alias("node"), "via", "chain", "edges", net.metres().alias("m"), net.metres_of("4wd").alias("m4"), net.costs(weights).alias("c"))
    priced = _paid(way.join(of, ["prev", "node"]), _largest(penalties))
    one = priced.groupBy("trip", "node").agg(F.min(F.struct("c", "via", "chain", "edges", "m", "m4")).alias("s"))
    return kept(way.join(one, ["trip", "node"]).select(*way.columns, "s.via", "s.chain", "s.edges", "s.m", "s.m4"))


def steps_back(reached: DataFrame, goals: DataFrame) -> DataFrame:
    """The rows of reached that are on the way to each search's goal (trip, node), the start's left out; none for goals that are out of reach.

    By pointer doubling: with the vertices up to 2^k hops before a goal and each vertex's 2^k-th
    before it, one join gives those up to 2^(k+1), so ways of n hops take log n joins.
    """
    scratch = Scratch(reached.sparkSession, "ways")
    ends = reached.join(goals.select("trip", "node").distinct(), ["trip", "node"])
    longest = ends.agg(F.max("hops")).first()[0] or 0
    chain = scratch.put("chain", ends.select("trip", "node"))
    jump = scratch.put("jump", reached.join(goals.select("trip").distinct(), "trip", "left_semi").where("prev IS NOT NULL").select("trip", "node", F.col("prev").alias("up")))
    span = 1
    while span <= longest:
        chain = scratch.put("chain", chain.union(chain.join(jump, ["trip", "node"]).select("trip", "up")))
        span *= 2
        if span <= longest:
            further = jump.select("trip", F.col("node").alias("up"), F.col("up").alias("next"))
            jump = scratch.put("jump", jump.join(further, ["trip", "up"]).select("trip", "node", F.col("next").alias("up")))
    on_way = kept(reached.where("prev IS NOT NULL").join(chain, ["trip", "node"], "left_semi"))
    scratch.clear()
    return on_way


#: Vertices that a search from both ends goes on from in its first round, for each trip and end, and how many times as many in the next.
FIRST, MORE = 16, 8


def linked(net: Network, wanted: DataFrame) -> DataFrame:
    """trip of the wanted trips (trip, start, goal) between whose ends there is a way.

    A vertex belongs to the end that met it first and is gone on from once, however many trips there are. Ends whose vertices meet are
    one group; a trip is settled when its ends are in one group, or one of their groups has no vertex left to go on from.
    """
    scratch = Scratch(wanted.sparkSession, "linked")
    # written, so that its size is known: a few vertices are looked up in the steps, which then need not be shuffled
    ends = scratch.put("ends", wanted.select(F.col("start").alias("node")).union(wanted.select(F.col("goal").alias("node"))).distinct())
    met = scratch.put("met", net.steps.select(F.col("src").alias("node")).join(ends, "node", "left_semi").distinct().select("node", F.col("node").alias("end"), F.lit(1).alias("fresh")))
    group = scratch.put("group", met.select("end", F.col("end").alias("of")))
    of = lambda end, name: group.select(F.col("end").alias(end), F.col("of").alias(name))
    while True:
        placed = wanted.join(of("start", "a"), "start").join(of("goal", "b"), "goal").select("trip", "a", "b")
        alive = met.where("fresh = 1").join(group, "end").select("of").distinct()
        apart = placed.where("a <> b").join(alive.withColumnRenamed("of", "a"), "a", "left_semi").join(alive.withColumnRenamed("of", "b"), "b", "left_semi")
        asked = scratch.put("asked", apart.select(F.col("a").alias("of")).union(apart.select("b")).distinct())
        if asked.isEmpty():
            break
        front = scratch.put("front", met.where("fresh = 1").join(group.join(asked, "of", "left_semi"), "end", "left_semi").select("node", "end"))
        seen = scratch.put("seen", front.join(net.steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "end").distinct())
        # a vertex that was met before stays with its end
        rows = met.select("node", F.lit(0).alias("new"), "end", "fresh").unionByName(front.select("node", F.lit(0).alias("new"), "end", F.lit(0).alias("fresh"))).unionByName(seen.select("node", F.lit(1).alias("new"), "end", F.lit(1).alias("fresh")))
        met = scratch.put("met", rows.groupBy("node").agg(F.min(F.struct("new", "end", "fresh")).alias("m")).select("node", "m.end", "m.fresh"))
        touch = scratch.put("touch", seen.join(met.select("node", F.col("end").alias("other")), "node").where("end <> other").select("end", "other").distinct())
        while True:
            pairs = touch.join(of("end", "a"), "end").join(of("other", "b"), "other").where("a <> b")
            lower = scratch.put("lower", pairs.groupBy(F.greatest("a", "b").alias("of")).agg(F.min(F.least("a", "b")).alias("to")))
            if lower.isEmpty():
                break
            group = scratch.put("group", group.join(lower, "of", "left").select("end", F.coalesce("to", "of").alias("of")))
    scratch.append("able", placed.where("a = b").select("trip"))
    scratch.clear()
    return scratch.appended("able", wanted.select("trip"))


def between(net: Network, wanted: DataFrame, weights: dict[str, float] | None = None, penalties: DataFrame | None = None, sure: bool = False) -> tuple[DataFrame, DataFrame]:
    """(found, way) of the wanted trips (trip, start, goal): found: trip, of those whose goal is within reach. way: trip, prev, node, hops, the steps of a cheapest way, numbered in their order by hops.

    sure: all of them are known to have a way.

    Each round goes on from the cheapest vertices of each trip and end, more of them from round to round. With `best` the cheapest way that was found
    so far, and `low` what the cheapest vertex of an end costs that is still to be gone on from: a cheaper way leaves the vertices of
    both ends that were gone on from by one that was not, so it costs the sum of both `low` at least; and a vertex that costs `best` less the other end's `low` is on no cheaper way.
    """
    scratch = Scratch(wanted.sparkSession, "between")
    able = wanted.select("trip") if sure else linked(net, wanted)
    penalties = None if penalties is None else scratch.put("penalties", _largest(penalties))
    steps = net.steps.select("src", "dst", *(["chain"] if penalties is not None else []), net.costs(weights).alias("c"))
    key = ["trip", "side"]
    at = lambda c, side: wanted.join(able, "trip", "left_semi").select("trip", F.lit(side).alias("side"), F.col(c).alias("node"))
    state = at("start", 0).union(at("goal", 1)).select(*key, "node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("prev"), F.lit(1).alias("fresh"))
    state = scratch.put("state", state)

    def met() -> DataFrame:
        """trip, node, cost, hops: the vertices that both ends have reached, and the ways through them."""
        one = lambda side: state.where(F.col("side") == side).select("trip", "node", F.col("cost").alias(f"cost_{side}"), F.col("hops").alias(f"hops_{side}"))
        return one(0).join(one(1), ["trip", "node"]).select("trip", "node", (F.col("cost_0") + F.col("cost_1")).alias("cost"), (F.col("hops_0") + F.col("hops_1")).alias("hops"))

    most = FIRST
    while True:
        low = lambda side: F.min(F.when((F.col("side") == side) & (F.col("fresh") == 1), F.col("cost"))).alias(f"low_{side}")
        bounds = state.groupBy("trip").agg(low(0), low(1)).join(met().groupBy("trip").agg(F.min("cost").alias("best")), "trip", "left")
        bounds = scratch.put("bounds", bounds.where("low_0 + low_1 < coalesce(best, double('Infinity'))"))
        if bounds.isEmpty():
            break
        other = F.when(F.col("side") == 0, F.col("low_1")).otherwise(F.col("low_0"))
        useful = state.where("fresh = 1").join(bounds, "trip").where(F.col("best").isNull() | (F.col("cost") + other < F.col("best")))
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("cost", "node"))
        front = scratch.put("front", useful.withColumn("nth", nth).where(F.col("nth") <= most).select(*state.columns, "best"))
        moved = _paid(front.join(steps, F.col("node") == F.col("src")), penalties).withColumn("cost", F.col("cost") + F.col("c")).where("best IS NULL OR cost < best")
        made = moved.select(*key, F.col("dst").alias("node"), "cost", (F.col("hops") + 1).alias("hops"), F.col("src").alias("prev"), F.lit(1).alias("fresh"))
        gone = front.drop("best").withColumn("fresh", F.lit(0))
        merged = state.unionByName(gone).unionByName(made).groupBy(*key, "node").agg(F.min(F.struct("cost", "hops", "prev")).alias("m"), F.min(F.struct("cost", "fresh")).alias("f"))
        state = scratch.put("state", merged.select(*key, "node", "m.cost", "m.hops", "m.prev", "f.fresh"))
        most *= MORE
    spots = scratch.put("spots", met().groupBy("trip").agg(F.min(F.struct("cost", "hops", "node")).alias("m")).select("trip", "m.node"))
    # a vertex may have become cheaper by a rounding after its neighbours were reached from it, so it may have more hops than they; what they cost is in order all the same
    chain = scratch.put("chain", spots.select("trip", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "node"))
    jump = scratch.put("jump", state.where("prev IS NOT NULL").select(*key, "node", F.col("prev").alias("up")))
    while not jump.isEmpty():
        chain = scratch.put("chain", chain.union(chain.join(jump, [*key, "node"]).select(*key, "up")))
        jump = scratch.put("jump", jump.join(jump.select(*key, F.col("node").alias("up"), F.col("up").alias("next")), [*key, "up"]).select(*key, "node", F.col("next").alias("up")))
    told = state.where("prev IS NOT NULL").join(chain, [*key, "node"], "left_semi")
    turned, sign = F.col("side") == 1, F.when(F.col("side") == 1, -1).otherwise(1)
    nth = F.row_number().over(Window.partitionBy("trip").orderBy("side", sign * F.col("cost"), sign * F.col("hops")))
    way = told.select("trip", F.when(turned, F.col("node")).otherwise(F.col("prev")).alias("prev"), F.when(turned, F.col("prev")).otherwise(F.col("node")).alias("node"), nth.alias("hops"))
    found = spots.select("trip")
    scratch.append("way", way)
    scratch.append("found", found)
    scratch.clear()
    return scratch.appended("found", found), scratch.appended("way", way)


def edges_of(net: Network, steps: DataFrame) -> DataFrame:
    """trip, nth (from 1), eid, src, dst: the edges of ways given as of steps_back, in order."""
    if net.plain:
        nth = F.row_number().over(Window.partitionBy("trip").orderBy("hops"))
        return steps.select("trip", nth.alias("nth"), F.col("chain").alias("eid"), F.col("prev").alias("src"), F.col("node").alias("dst"))
    inside = steps.select("trip", "hops", "via").join(net.arcs, F.col("via") == F.col("last"))
    order = Window.partitionBy("trip").orderBy("hops", F.desc("left"))
    return inside.withColumn("nth", F.row_number().over(order)).select("trip", "nth", "eid", "src", "dst")


def distances(edges: DataFrame, source: str, weights: dict[str, float] | None = None) -> DataFrame:
    """node, cost: of the cheapest way from source to every vertex within reach, those inside chains included."""
    one = edges.sparkSession.createDataFrame([("", source)], "trip string, node string")
    return search(uncontracted(edges), one, weights).select("node", "cost")


def farthest_way(edges: DataFrame, source: str, weights: dict[str, float] | None = None) -> DataFrame:
    """nth, eid, src, dst: the cheapest way from source to the vertex that is dearest to reach; one search finds both."""
    net = uncontracted(edges)
    reached = search(net, edges.sparkSession.createDataFrame([("", source)], "trip string, node string"), weights)
    last = reached.groupBy("trip").agg(F.max_by("node", F.struct("cost", "node")).alias("node"))
    return edges_of(net, named(net, steps_back(reached, last), weights)).select("nth", "eid", "src", "dst")


def cheapest_ways(edges: DataFrame, wanted: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """trip, nth, eid, src, dst: the cheapest way of each wanted trip (trip, start, goal); none where the goal is out of reach."""
    wanted = kept(wanted.select("trip", "start", "goal"))
    net = contract(edges, wanted.select(F.col("start").alias("node")).union(wanted.select("goal")))
    return edges_of(net, named(net, between(net, wanted, weights)[1], weights))


def trips(edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, legs) of trips from a start to a goal and back. wanted: trip, start, goal, shape (one of SHAPES).

    summary: trip, reachable, shape, shared, share_4wd, length_m. A loop's way back is looked for with the edges of the way out
    made dearer, and stays a loop if the edges that both have are at most MOST_SHARED of those of the
    way out. A 4wd trip has a way of its own, by the weights of such a day, and stays one if at least LEAST_4WD of its
    metres are 4wd; it is gone both ways. All else is out and back. A trip whose goal is out of reach, or that starts or ends outside
    the network, is not reachable; it has no shape and no legs.
    legs: trip, leg (0 out, 1 back), nth, eid, src, dst.
    """
    wanted = kept(wanted.select("trip", "start", "goal", "shape"))
    net = contract(edges, wanted.select(F.col("start").alias("node")).union(wanted.select("goal")))
    found, way = between(net, wanted, WEIGHTS["outing"])
    out = named(net, way, WEIGHTS["outing"])
    of = lambda kind: wanted.where(F.col("shape") == kind).join(found, "trip", "left_semi")
    # loops
    loops = of("loop")
    dear = out.join(loops, "trip", "left_semi").select("trip", "chain", F.lit(TURNED_PENALTY).alias("factor"))
    back_of = loops.select("trip", F.col("goal").alias("start"), F.col("start").alias("goal"))
    home = lambda: named(net, between(net, back_of, WEIGHTS["outing"], dear, sure=True)[1], WEIGHTS["outing"], dear)
    # 4wd ways, looked for at the same time
    rough = of("4wd")
    apart = lambda: named(net, between(net, rough, WEIGHTS["4wd_day"], sure=True)[1], WEIGHTS["4wd_day"])
    with ThreadPoolExecutor(2) as pool:
        back, own = (run.result() for run in [pool.submit(home), pool.submit(apart)])
    n_out = out.groupBy("trip").agg(F.sum("edges").alias("n_out"), F.sum("m").alias("m_out"))
    common = back.join(out.select("trip", "chain").distinct(), ["trip", "chain"], "left_semi").groupBy("trip").agg(F.sum("edges").alias("n_common"))
    shares = own.groupBy("trip").agg((F.sum("m4") / F.sum("m")).alias("share_4wd"), F.sum("m").alias("m_own"))
    m_back = back.groupBy("trip").agg(F.sum("m").alias("m_back"))
    joined = reduce(lambda a, b: a.join(b, "trip", "left"), [found.withColumn("reachable", F.lit(True)), n_out, common, shares, m_back], wanted)
    shared = F.when((F.col("shape") == "loop") & F.col("reachable"), F.coalesce(F.col("n_common") / F.col("n_out"), F.lit(0.0)))
    told = joined.withColumns({"reachable": F.coalesce("reachable", F.lit(False)), "shared": shared})
    is_loop = (F.col("shape") == "loop") & (F.col("shared") <= MOST_SHARED)
    is_4wd = (F.col("shape") == "4wd") & (F.coalesce("share_4wd", F.lit(0.0)) >= LEAST_4WD)
    became = F.when(~F.col("reachable"), None).when(is_loop, "loop").when(is_4wd, "4wd").otherwise("out_and_back")
    out_m = F.coalesce("m_out", F.lit(0.0))
    length = F.when(became == "loop", out_m + F.coalesce("m_back", F.lit(0.0))).when(became == "4wd", 2 * F.col("m_own")).when(became.isNotNull(), 2 * out_m)
    summary = kept(told.select("trip", "reachable", became.alias("became"), "shared", "share_4wd", length.alias("length_m")).withColumnRenamed("became", "shape"))
    kinds = summary.select("trip", "shape")
    there = out.join(kinds.where("shape <> '4wd'"), "trip", "left_semi").unionByName(own.join(kinds.where("shape = '4wd'"), "trip", "left_semi"))
    legs_out = kept(edges_of(net, there))
    turned = legs_out.join(kinds.where("shape <> 'loop'"), "trip", "left_semi")
    last = Window.partitionBy("trip")
    home = turned.select("trip", (F.max("nth").over(last) + 1 - F.col("nth")).alias("nth"), "eid", F.col("dst").alias("src"), F.col("src").alias("dst"))
    round_ = edges_of(net, back.join(kinds.where("shape = 'loop'"), "trip", "left_semi"))
    legs = legs_out.withColumn("leg", F.lit(0)).unionByName(home.unionByName(round_).withColumn("leg", F.lit(1)))
    return summary, legs.select("trip", "leg", "nth", "eid", "src", "dst")


def spacing_m(native_m: Column) -> Column:
    """Metres between the points of a trip: SPACING_PX printed pixels, LEAST_SPACING_M at least."""
    return F.greatest(F.lit(LEAST_SPACING_M), F.coalesce(native_m, F.lit(0.0)) * SPACING_PX)


def n_points(length_m: Column, spacing: Column | float) -> Column:
    """Points of a trip: one a spacing, two at least."""
    return F.least(F.lit(MOST_TRIP_POINTS), F.greatest(F.lit(2), F.floor(length_m / F.greatest(F.lit(1e-9), F.lit(spacing) if isinstance(spacing, float) else spacing)).cast("int")))


def within_budget(lengths: DataFrame, spacing: float, most: int = MOST_POINTS, rounds: int = 4) -> tuple[float, DataFrame]:
    """(spacing, lengths with n_points): all trips, set coarser together until their points fit; lengths: length_m, null for trips that have no points.

    Points are in inverse proportion to the spacing, so a round nearly settles it; a sum is all that reaches the driver.
    """
    total = lambda s: lengths.where("length_m IS NOT NULL").agg(F.coalesce(F.sum(n_points(F.col("length_m"), s)), F.lit(0))).first()[0]
    for _ in range(rounds):
        n = total(spacing)
        if n <= most:
            break
        spacing *= COARSER * n / most
    return spacing, lengths.withColumn("n_points", F.when(F.col("length_m").isNotNull(), n_points(F.col("length_m"), spacing)))
