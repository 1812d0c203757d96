"""Communities of an undirected graph: modularity raised level by level, isolates, splits, cohesion; components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from .order import placed


def undirected(calls: DataFrame) -> DataFrame:
    """a < b: parallel and opposite edges collapse, self-loops go."""
    return calls.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


#: Levels end when one adds less than this to the modularity.
THRESHOLD = 1e-4


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Of a partition (uid, community) of the ends of undirected ``edges`` (a, b): edges inside beyond what chance gives."""
    both = _both(edges).withColumn("w", F.lit(1.0))
    total = edges.count() * 2.0
    return _quality(both, members, total) if total else 0.0


def _quality(both: DataFrame, label: DataFrame, total: float) -> float:
    at = label.select("uid", "community")
    ends = both.join(at.select(F.col("uid").alias("u"), F.col("community").alias("cu")), "u").join(at.select(F.col("uid").alias("v"), F.col("community").alias("cv")), "v")
    each = ends.groupBy("cu").agg(F.sum("w").alias("mass"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    found = each.agg(F.sum(F.col("inside") / total - F.pow(F.col("mass") / total, 2))).first()[0]
    return found or 0.0


#: Links up to which the turns are taken in one task; beyond it each is a few jobs. Both give the same communities.
LOCAL = 1_000_000


def _side(community: Column, turn: int) -> Column:
    return F.xxhash64(community, F.lit(turn).cast("long"))


def _best(both: DataFrame, label: DataFrame, total: int, turn: int) -> DataFrame:
    """u, k, own, home, inside and the ends of a turn: ``community`` among the open ones, ``wish`` among all, and
    ``delta``, what the wish gains. Gains are integers, of weights times ``total``, so that no sum rounds."""
    mass = label.groupBy("community").agg(F.sum("k").alias("mass"))
    links = both.where("u <> v").join(label.select(F.col("uid").alias("v"), "community"), "v").groupBy("u", "community").agg(F.sum("w").alias("links"))
    own = label.select(F.col("uid").alias("u"), F.col("community").alias("home"), "k", "own")
    # staying is an option too, even without a link inside
    stay = own.select("u", F.col("home").alias("community"), F.lit(0).cast("long").alias("links"), "home", "k", "own")
    options = links.join(own, "u").unionByName(stay).join(mass, "community")
    stays = F.col("community") == F.col("home")
    gain = F.col("links") * F.lit(total).cast("long") - F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(F.lit(0).cast("long")))
    open_ = stays | ((_side(F.col("home"), turn) % 2 == 0) & (_side(F.col("community"), turn) % 2 != 0))
    order = F.struct(gain.alias("gain"), stays.alias("stays"), F.expr("~xxhash64(community)"))
    best = options.groupBy("u", "home", "k", "own").agg(
        F.max_by("community", order).alias("wish"),
        F.max_by("community", F.when(open_, order)).alias("community"),
        (F.max(F.when(stays, F.col("links"))) + F.first("own")).alias("inside"),
        (F.max(gain) - F.max(F.when(stays, gain))).alias("delta"),
    )
    return best.withColumn("gains", F.col("delta") > 0)


def _turn(both: DataFrame, label: DataFrame, total: int, turn: int) -> DataFrame:
    """``label`` (uid, community, k, own) after a turn: the nodes of half the communities, by a hash of the turn, join
    that one of the other half, all at once, which gains most, ties to the least hash. So two nodes never swap, and
    none follows one that leaves. Beside it home, where each was, its weight inside there, and apart, where it would be
    if of all moves only those were made that gain most both of those from their home and of those to their aim and
    the reverse: these touch no community twice, so their gains add up."""
    best = _best(both, label, total, turn)
    moves = best.where("gains").select("u", "home", "wish", "delta")
    key = F.struct("delta", "u")
    ends = moves.select(F.explode(F.array("home", "wish")).alias("c"), key.alias("key")).groupBy("c").agg(F.max("key.delta").alias("delta"), F.max("key").alias("key"))
    first = ends.select("c", F.col("key.u").alias("first"))
    kept = moves.join(first.select(F.col("c").alias("home"), F.col("first").alias("f")), "home").join(first.select(F.col("c").alias("wish"), F.col("first").alias("g")), "wish").where("f = u and g = u")
    out = best.join(kept.select("u", F.col("wish").alias("to")), "u", "left")
    return cut(out.select(F.col("u").alias("uid"), "community", "k", "own", "home", "inside", F.coalesce("to", "home").alias("apart")))


def _judged(after: DataFrame, total: int) -> tuple[int, int, int]:
    """Of the state before a turn: its modularity (an integer, times the square of ``total``); how many moved, how many
    would apart."""
    each = after.groupBy("home").agg(
        F.sum("k").alias("mass"), F.sum("inside").alias("inside"), F.count_if(F.col("community") != F.col("home")).alias("moved"), F.count_if(F.col("apart") != F.col("home")).alias("apart")
    )
    square = (F.col("mass").cast("decimal(38,0)") * F.col("mass")).cast("decimal(38,0)")
    row = each.agg(F.sum("inside").alias("inside"), F.sum(square).alias("square"), F.sum("moved").alias("moved"), F.sum("apart").alias("apart")).first()
    return int(row["inside"]) * total - int(row["square"]), row["moved"], row["apart"]


def _level(start, take, judge):
    """The state at the end of a level, and its modularity: turns until no node gains by moving. ``take`` makes a turn
    of a state and ``judge`` judges the state before it; a turn that gained nothing, as nodes moved at once or none was
    open, is taken back, and the moves that touch no community twice are made instead, which always gain."""
    now, turn = take(start, 0), 0
    quality, moved, apart = judge(now)
    while apart:
        turn += 1
        if moved:
            then = take((now, "community"), turn)
            reached = judge(then)
            if reached[0] > quality:
                now, (quality, moved, apart) = then, reached
                continue
        now = take((now, "apart"), turn)
        quality, moved, apart = judge(now)
    return now, quality


def _local(both: DataFrame, total: int) -> tuple[DataFrame, int]:
    """uid, community, and its modularity, a few jobs a turn."""
    start = both.groupBy("u").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(F.lit(0).cast("long"))).alias("own"))
    first = start.select(F.col("u").alias("uid"), F.col("u").alias("community"), "k", "own")
    take = lambda s, turn: _turn(both, s[0].select("uid", F.col(s[1]).alias("community"), "k", "own"), total, turn)
    now, quality = _level((first, "community"), take, lambda after: _judged(after, total))
    return now.select("uid", F.col("home").alias("community")), quality


def _by_jobs(numbers: DataFrame, total: int) -> DataFrame:
    """uid, community of numbered links (a, b)."""
    both = cut(_both(numbers).withColumn("w", F.lit(1).cast("long")))
    label, quality = _local(both, total)
    known = label
    while True:
        at = known.select("uid", "community")
        both = both.join(at.select(F.col("uid").alias("u"), F.col("community").alias("cu")), "u").join(at.select(F.col("uid").alias("v"), F.col("community").alias("cv")), "v")
        both = cut(both.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        known, reached = _local(both, total)
        if reached - quality < THRESHOLD * total * total:
            return label
        quality = reached
        label = cut(label.join(known.select(F.col("uid").alias("community"), F.col("community").alias("above")), "community").select("uid", F.col("above").alias("community")))


def _hashed(x: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (np.asarray(seed).astype(np.uint64) + p5 + np.uint64(8)) ^ (turned(x.astype(np.uint64) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _array_level(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, total: int) -> tuple[np.ndarray, int]:
    """The community of each of ``n`` nodes and the modularity, as :func:`_local` finds them; u, v, w are all links in
    both directions."""
    k, own = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(k, u, w)
    np.add.at(own, u[u == v], w[u == v])
    far = u != v
    u, v, w = u[far], v[far], w[far]
    nodes = np.arange(n)
    base = _hashed(nodes, 42)
    tie = ~base.view(np.int64)
    place = np.empty(n, np.int64)  # places in the order of the hash keep ties of a community apart
    place[np.argsort(tie, kind="stable")] = nodes

    def take(state, turn):
        home = state[0] if state[1] is None else state[0][state[1]]
        mass = np.zeros(n, np.int64)
        np.add.at(mass, home, k)
        key, at = np.unique(np.concatenate([u * n + home[v], nodes * n + home]), return_inverse=True)
        links = np.zeros(len(key), np.int64)
        np.add.at(links, at[: len(u)], w)
        who, where = key // n, key % n
        stays = where == home[who]
        gain = links * total - k[who] * (mass[where] - np.where(stays, k[who], 0))
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1]))  # every node stays or goes
        rank = np.where(stays, n, place[where])

        def chosen(gain):
            most = np.maximum.reduceat(gain, start)
            top = np.maximum.reduceat(np.where(gain == most[who], rank, -1), start)
            return where[(gain == most[who]) & (rank == top[who])], most

        wish, most = chosen(gain)
        side = _hashed(np.full(n, turn), base) % np.uint64(2)
        community, _ = chosen(np.where(stays | ((side[home[who]] == 0) & (side[where] == 1)), gain, np.iinfo(np.int64).min))
        delta, inside = most - gain[stays], links[stays] + own
        apart = home.copy()
        moving = np.flatnonzero(delta > 0)
        if len(moving):
            c = np.concatenate([home[moving], wish[moving]])
            m = np.concatenate([moving, moving])
            order = np.lexsort((m, delta[m], c))
            c, m = c[order], m[order]
            ends = np.append(c[1:] != c[:-1], True)
            first = np.full(n, -1)
            first[c[ends]] = m[ends]
            kept = moving[(first[home[moving]] == moving) & (first[wish[moving]] == moving)]
            apart[kept] = wish[kept]
        return {"community": community, "home": home, "apart": apart, "inside": inside, "mass": mass}

    def judge(after):
        # squares of masses may add up to more than a long holds
        square = sum(int(x) for x in np.add.reduceat(after["mass"] ** 2, np.arange(0, n, 4096)))
        return int(after["inside"].sum()) * total - square, int((after["community"] != after["home"]).sum()), int((after["apart"] != after["home"]).sum())

    now, quality = _level((nodes, None), take, judge)
    return now["home"], quality


def _by_arrays(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The community of each of ``n`` numbered nodes, as :func:`_by_jobs` finds it."""
    total = 2 * len(a)
    u, v, w = np.concatenate([a, b]), np.concatenate([b, a]), np.ones(total, np.int64)
    label, quality = _array_level(u, v, w, n, total)
    known, names = label, np.arange(n)
    while True:
        # the communities are the next level's nodes; they keep their numbers, by which turns and ties are drawn
        pair, at = np.unique(known[u] * n + known[v], return_inverse=True)
        weight = np.zeros(len(pair), np.int64)
        np.add.at(weight, at, w)
        u, v, w = pair // n, pair % n, weight
        known, reached = _array_level(u, v, w, n, total)
        if reached - quality < THRESHOLD * total * total:
            return names[label]
        quality, label = reached, known[label]


def detect(edges: DataFrame) -> DataFrame:
    """uid, community: modularity is raised level by level. On each, nodes move between communities; then communities
    become the nodes of the next level, their links weighted, until a level gains less than ``THRESHOLD``. Up to
    ``LOCAL`` links that is done in one task. Nodes go by their places in order, communities by one of their nodes."""
    count = edges.count()
    if not count:
        return edges.select(F.col("a").alias("uid"), F.col("a").alias("community"))
    ends = edges.select(F.col("a").alias("uid")).union(edges.select("b")).distinct()
    names = cut(placed(ends, ["uid"], "place").select("uid", (F.col("place").cast("long") - 1).alias("number")))
    at = lambda c: names.select(F.col("uid").alias(c), F.col("number").alias(f"n_{c}"))
    numbers = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for x in batches if x.num_rows]
        if found:
            a, b = (np.concatenate([x.column(c).to_numpy() for x in found]) for c in (0, 1))
            n = int(max(a.max(), b.max())) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(_by_arrays(a, b, n))], names=["uid", "community"])

    if count <= LOCAL:
        ship(edges.sparkSession)
        label = cut(numbers.repartition(1).mapInArrow(run, "uid long, community long"))
    else:
        label = _by_jobs(numbers, 2 * count)
    named = label.select(F.col("uid").alias("number"), F.col("community").alias("c")).join(names, "number")
    return cut(named.join(names.select(F.col("number").alias("c"), F.col("uid").alias("community")), "c").select("uid", "community"))


def components(edges: DataFrame) -> DataFrame:
    """uid, component: the least node that each node of undirected ``edges`` (a, b) reaches, by labels and jumps."""
    both = cut(_both(edges))
    label = cut(both.select("u").distinct().select("u", F.col("u").alias("c")))
    while True:
        seen = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        new = label.join(seen, "u").select("u", F.least("c", "m").alias("n"), "c")
        # a jump: the label of the label
        jump = cut(new.join(new.select(F.col("u").alias("n"), F.col("n").alias("far")), "n").select("u", F.least("n", "far").alias("n"), "c"))
        if jump.where("n <> c").isEmpty():
            return label.select(F.col("u").alias("uid"), F.col("c").alias("component"))
        label = jump.select("u", F.col("n").alias("c"))


def numbered(members: DataFrame) -> DataFrame:
    """uid, community_id: communities numbered by size, largest first, then by their least member."""
    size = members.groupBy("community").agg(F.count("*").alias("n"), F.min("uid").alias("first"))
    order = placed(size, [F.desc("n"), F.col("first")], "place").select("community", (F.col("place") - 1).alias("community_id"))
    return members.join(order, "community").select("uid", "community_id")


def hubs(edges: DataFrame, nodes: DataFrame, percentile: float) -> DataFrame:
    """uid, degree: ``nodes`` with more neighbours than the one at a percentile of all degrees, isolates included.

    The threshold is read from the histogram of degrees, which has a row for each distinct degree.
    """
    counts = _both(edges).groupBy(F.col("u").alias("uid")).agg(F.count("*").alias("degree"))
    degree = nodes.select("uid").join(counts, "uid", "left").na.fill(0, ["degree"])
    histogram = degree.groupBy("degree").agg(F.count("*").alias("n"))
    running = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = F.greatest(F.lit(0), F.floor(F.col("all") * F.lit(percentile) / 100) - 1)
    threshold = running.where(F.col("upto") > at).agg(F.min("degree").alias("threshold"))  # one row
    return degree.crossJoin(F.broadcast(threshold)).where(F.col("degree") > F.col("threshold")).select("uid", "degree")


def attached(found: DataFrame, edges: DataFrame, hub: DataFrame) -> DataFrame:
    """``found`` (uid, community) with the hubs: each in the community of most of its neighbours, ties to the least."""
    votes = _both(edges).join(hub.select(F.col("uid").alias("u")), "u", "left_semi").join(found.select(F.col("uid").alias("v"), "community"), "v")
    won = votes.groupBy("u", "community").agg(F.count("*").alias("n")).groupBy("u").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
    return found.unionByName(won.withColumnRenamed("u", "uid"))


def communities(calls: DataFrame, nodes: DataFrame, hub_percentile: float | None = None) -> DataFrame:
    """uid, community_id of all ``nodes`` (uid); isolates are communities of one; oversized communities, and large
    loose ones, are split once by detection within. With ``hub_percentile``, nodes of more neighbours than that take
    no part in the detection and join the community of most of their neighbours."""
    edges = cut(undirected(calls))
    if hub_percentile is None:
        found = detect(edges)
    else:
        hub = cut(hubs(edges, nodes, hub_percentile))
        usual = edges.join(hub.select(F.col("uid").alias("a")), "a", "left_anti").join(hub.select(F.col("uid").alias("b")), "b", "left_anti")
        found = cut(attached(detect(cut(usual)), edges, hub))
    n = nodes.count()
    size = found.groupBy("community").agg(F.count("*").alias("n"))
    inner = cut(edges.join(found.select(F.col("uid").alias("a"), F.col("community").alias("ca")), "a").join(found.select(F.col("uid").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb"))
    loose = cohesion(inner.select("a", "b", F.col("ca").alias("community")), size)
    split = loose.where((F.col("n") > max(10, n // 4)) | ((F.col("n") >= 50) & (F.col("cohesion") < 0.05))).select("community")
    split = cut(split)
    if not split.isEmpty():
        again = detect(inner.join(split.withColumnRenamed("community", "ca"), "ca", "left_semi").select("a", "b"))
        found = found.join(again.withColumnRenamed("community", "part"), "uid", "left").select("uid", F.concat_ws("/", "community", "part").alias("community"))
    alone = nodes.select("uid").join(found, "uid", "left_anti").select("uid", F.col("uid").alias("community"))
    return numbered(found.unionByName(alone))


def cohesion(inner: DataFrame, size: DataFrame) -> DataFrame:
    """community, n, cohesion: edges inside over pairs inside; one for single members."""
    count = inner.groupBy("community").agg(F.count("*").alias("e"))
    ratio = F.coalesce("e", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)
    return size.join(count, "community", "left").select("community", "n", F.when(F.col("n") <= 1, 1.0).otherwise(ratio).alias("cohesion"))
