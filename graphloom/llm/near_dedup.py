"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are folded into one representative, the document with the smallest
id. ``TREES`` independent trees branch the representatives by minwise tokens: all that share the minwise token of a
tree's first coordinate form a node. Members of small nodes are compared exhaustively by sketch. In a larger node
those near to its pivot, the member nearest to the node's most common tokens, are linked with it first; then what is not
linked yet is compared exhaustively too, or, if that is still too much, the node branches again, on two coordinates that
its own path chooses. A node whose members are all linked is done, so the copies of one text, in a group of any size, are
through with one comparison each. Components are looked up once a level, for the members of larger nodes after their
stars; only nodes that still have too many pairs branch.

Work is dealt in cells of bounded size: members of a small node outside its largest component, some 2,000 at most, are
one part, those inside are cut by a hash into parts no smaller, and every two parts that hold members of different
components meet in a cell, so that a member has few copies. Parts of long texts, and of what is left after ``LEVELS``,
are smaller: ``PART_SHINGLES``, ``PART``. Members that candidates (a
sketched similarity of ``NEAR``) connect within a cell form a block, named by its members, so that the same block of
several trees is one. In a block every pair is confirmed on full shingle sets through an inverted list of shingles,
and its components are handed on as stars, so rows stay linear in a group of copies.

Recall: links of similarity J meet in a tree's first node with chance J, so 8 trees miss a link of 0.8 with a chance
of 3 in a million; each further branching on two coordinates keeps a link with chance 1 - (1 - J)**2 = 0.96. The
sketch (120 coordinates of 8 bits) of a link of exactly 0.8 falls below ``NEAR`` once in about 8,000 times. What is still large
after ``LEVELS`` is compared exhaustively, cell by cell.

Defined results: null and empty texts have no set and are linked with nothing; a text of fewer words than a shingle
is one shingle; rows with a null doc_id are kept unlinked (component_id null); repeated rows of one doc_id that have
sets share their component, whether their texts are equal or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Hashes, by_key, forget, materialise, mix, prepare, table
from .components import components, roots

#: Words in a shingle and the least similarity in percent.
WIDTH, PERCENT = 5, 80
TREES, COORDINATES = 8, 120
NEAR = 0.66
#: Pairs of members in different components up to which a node is compared exhaustively.
SMALL = 2_000_000
#: Members and shingles of a part: two parts meet in a task.
PART, PART_SHINGLES = 256, 500_000
#: Levels of the trees, far beyond what nodes of unlinked members need.
LEVELS = 24
#: Rows of blocks up to which their ids are broadcast to the texts (some 80 bytes each); beyond it texts are shuffled.
BROADCAST_ROWS = 200_000
#: Members of a node, drawn by lot, that elect the tokens of its pivot (about so many).
VOTERS = 64
#: Nodes of a level (some 100 bytes each), and nodes that get a star (some 300), up to which they are broadcast.
BROADCAST_NODES, BROADCAST_STARS = 100_000, 20_000

_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 32, (2, TREES + COORDINATES), dtype=np.uint64).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, known: Hashes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words, sorted; of the whole text if it has fewer."""
    t = known.of(text.lower().split()) if text else np.empty(0, np.uint64)
    if not len(t):
        return t
    n = min(width, len(t))
    h = np.full(len(t) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * _STEP + t[k : len(t) - n + 1 + k])
    return np.unique(h)


def digest(s: np.ndarray) -> bytes:
    """Names a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise value of each coordinate, over the shingles."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(TREES + COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        y = x[k : k + 4096, None] * (_SEEDS[0] | np.uint32(1)) + _SEEDS[1]
        y ^= y >> np.uint32(15)
        out = np.minimum(out, (y * np.uint32(0x2C1B3C6D)).min(0))
    return out


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, body (hash of the set), first (one value a tree) and sketch (8 bits a coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            n, body, first, sketch = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text, known, width)
                n.append(len(s))
                if len(s):
                    v = signature(s)
                    body.append(digest(s))
                    first.append(v[:TREES].astype(np.int64))
                    sketch.append(v[TREES:].astype(np.uint8).tobytes())
                else:
                    body.append(None), first.append(None), sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(body, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "body", "first", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, body binary, first array<long>, sketch binary")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


_BLOCK = "block long, rep long, id long, body binary"


def _block_batches(block: np.ndarray, at: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Members of blocks: the rows at places ``at`` with their blocks."""
    taken = rows.select(["rep", "id", "body"]).take(pa.array(at))
    yield from pa.table([pa.array(block, pa.int64()), *taken.columns], names=["block", "rep", "id", "body"]).to_batches()


def candidates(rep: np.ndarray, own: np.ndarray, n: np.ndarray, side: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of members that candidates connect, and the name of each one's block.

    Members of different components (``own``) are compared: all if ``side`` is 0, else those of side 1 with those of
    side 2.
    """
    label = np.arange(len(rep))
    if side.max() == 0:
        # The largest component comes last: none of its members starts a comparison.
        _, at, size = np.unique(own, return_inverse=True, return_counts=True)
        order = np.lexsort((rep, own, size[at]))
        starts, ends = order[: len(rep) - int(size.max())], None
    else:
        order, starts, ends = None, np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    for k, i in enumerate(starts):
        j = ends if order is None else order[k + 1 :]
        j = j[(own[j] != own[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
        if len(j):
            j = j[(sketch[j] == sketch[i]).mean(1) >= NEAR]
            new = np.unique(label[j])
            if len(new) and (len(new) > 1 or new[0] != label[i]):
                label[np.isin(label, new)] = label[i]
    _, at, size = np.unique(label, return_inverse=True, return_counts=True)
    name = np.zeros(len(size), np.uint64)
    np.add.at(name, at, mix(rep.view(np.uint64)))
    place = np.flatnonzero(size[at] > 1)
    return place, mix(name + size.astype(np.uint64))[at[place]].view(np.int64)


def _offers(cells: DataFrame, percent: int) -> DataFrame:
    """Blocks of ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            if group.num_rows > 1:
                rep, own, n, side = (group.column(c).to_numpy() for c in ("rep", "component", "n", "side"))
                place, block = candidates(rep, own, n, side, _sketches(group.column("sketch")), percent)
                if len(place):
                    yield from _block_batches(block, place, group)

    return cells.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(run, _BLOCK)


def _cells(members: DataFrame) -> DataFrame:
    """Members of small nodes in cells: parts of the members outside the node's largest component (``top``) meet each
    other and the parts of those inside."""
    inside = F.coalesce(F.col("component") == F.col("top"), F.lit(False))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, a, b, side: F.struct(F.xxhash64("node", F.lit(kind), a, b).alias("cell"), side.cast("int").alias("side"))
    among = F.transform(every("out_parts"), lambda b: cell("out", F.least("own", b), F.greatest("own", b), F.when(b == F.col("own"), 0).when(b > F.col("own"), 1).otherwise(2)))
    to_in = F.when(F.col("in_parts") > 0, F.transform(every("in_parts"), lambda k: cell("in", F.col("own"), k, F.lit(1)))).otherwise(F.slice(among, 1, 0))
    from_in = F.transform(every("out_parts"), lambda a: cell("in", a, F.col("own"), F.lit(2)))
    dealt = members.withColumn("own", F.when(inside, part("in_parts")).otherwise(part("out_parts")))
    dealt = dealt.withColumn("at", F.explode(F.when(inside, from_in).otherwise(F.concat(among, to_in))))
    return dealt.select("at.cell", "at.side", "rep", "component", "n", "id", "body", "sketch")


_LARGE = "node long, rep long, component long, n long, size double, weight long, id long, body binary, sketch binary, same long"


def _large(nodes: DataFrame, chosen: DataFrame, n_nodes: int, sketches: DataFrame) -> DataFrame:
    """Members of large nodes, with ``same``: on how many coordinates each has the value that is the most common one
    among the node's voters."""
    few = n_nodes <= BROADCAST_STARS
    chosen = chosen.where("kind = 'large'").select("node", F.col("size").cast("double").alias("size"), F.col("weight").cast("long").alias("weight"))
    lot = F.pmod(F.xxhash64("rep", F.lit("voter")), F.lit(1 << 32))
    voters = nodes.join(F.broadcast(chosen) if few else chosen, (nodes["node"] == chosen["node"]) & (lot * chosen["size"] <= VOTERS * 2.0**32)).select(nodes["node"], "rep")
    voters = sketches.join(F.broadcast(voters) if n_nodes * VOTERS <= BROADCAST_ROWS else voters, "rep").select("node", "rep", "sketch")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            x = np.sort(_sketches(group.column("sketch")), 0)
            # the most frequent value of each coordinate: the longest run of its sorted values
            run = np.ones(x.shape, np.int32)
            for k in range(1, len(x)):
                run[k] = np.where(x[k] == x[k - 1], run[k - 1] + 1, 1)
            common = x[run.argmax(0), np.arange(x.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([group.column(0)[0].as_py()], pa.int64()), pa.array([common.tobytes()], pa.binary())], names=["node", "common"])

    common = voters.repartition("node").sortWithinPartitions("node", "rep").select("node", "sketch").mapInArrow(vote, "node long, common binary")
    # a node without a voter, should the lots fall so, has any member as its pivot
    chosen = chosen.join(common, "node", "left").withColumn("common", F.coalesce("common", F.lit(bytes(COORDINATES))))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_sketches(batch.column("sketch")) == _sketches(batch.column("common"))).sum(1)
                rows = batch.drop_columns(["common"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(same.astype(np.int64))], names=[*rows.schema.names, "same"])

    members = nodes.select("node", "rep", "component", "n").join(F.broadcast(chosen) if few else chosen, "node").join(sketches, "rep")
    return materialise(members.select("node", "rep", "component", "n", "size", "weight", "id", "body", "sketch", "common").mapInArrow(agree, _LARGE))


def _stars(members: DataFrame, n_nodes: int, percent: int) -> DataFrame:
    """Blocks of large nodes: members near to the node's pivot, with it, part by part."""
    few = n_nodes <= BROADCAST_STARS
    best = members.groupBy("node").agg(F.max(F.struct("same", F.negative("rep").alias("r"))).alias("w")).select("node", F.negative("w.r").alias("rep"))
    pivots = members.join(F.broadcast(best) if few else best, ["node", "rep"]).select(
        "node", *(F.col(c).alias(f"p_{c}") for c in ("rep", "component", "n", "sketch", "id", "body")), F.greatest(F.ceil(F.col("size") / PART), F.ceil(F.col("weight") / PART_SHINGLES)).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_sketches(batch.column("sketch")) == _sketches(batch.column("p_sketch"))).mean(1)
                rows = pa.Table.from_batches([batch.take(pa.array(np.flatnonzero(near >= NEAR)))])
                if rows.num_rows:
                    block = rows.column("block").to_numpy()
                    yield from _block_batches(block, np.arange(len(block)), rows)
                    _, first = np.unique(block, return_index=True)
                    pivot = rows.select(["p_rep", "p_id", "p_body"]).rename_columns(["rep", "id", "body"])
                    yield from _block_batches(block[first], first, pivot)

    met = members.join(F.broadcast(pivots) if few else pivots, "node").where("component <> p_component").where(100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n"))
    block = F.xxhash64("node", F.pmod(F.xxhash64("rep"), F.col("parts")))
    return met.select(block.alias("block"), "rep", "id", "body", "sketch", "p_rep", "p_id", "p_body", "p_sketch").mapInArrow(run, _BLOCK)


def _pairs(c) -> Column:
    """Pairs of members in different components, from the sizes ``c`` of a node's components."""
    return (F.pow(F.sum(c), F.lit(2)) - F.sum(c * c)) / 2


def _placed(members: DataFrame, homes: DataFrame) -> DataFrame:
    """``members`` with their components, written."""
    found = members.join(homes.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return materialise(found.withColumn("component", F.coalesce("component", "rep")))


def _children(members: DataFrame) -> DataFrame:
    """Two nodes a member of nodes that branch, on coordinates that the node's name chooses (one, if both are the same)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node = batch.column("node").to_numpy().view(np.uint64)
                sketch = _sketches(batch.column("sketch")).astype(np.uint64)
                names = []
                for k in (1, 2):
                    at = mix(node + np.uint64(k)) % np.uint64(COORDINATES)
                    value = sketch[np.arange(len(node)), at.astype(np.int64)]
                    names.append(mix(node * _STEP + at * np.uint64(65536) + value).view(np.int64))
                second = np.flatnonzero(names[0] != names[1])
                rows = batch.select(["rep", "component", "n"]).take(pa.array(np.concatenate([np.arange(len(node)), second])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([names[0], names[1][second]])), *rows.columns], names=["node", "rep", "component", "n"])

    return members.select("node", "rep", "component", "n", "sketch").mapInArrow(run, "node long, rep long, component long, n long")


def _descend(members: DataFrame, level: int) -> tuple[DataFrame | None, DataFrame | None]:
    """What large nodes hand to the next level once their stars are linked: nodes that they branch into, written, and the
    members of those that have few enough pairs left. The others, whose members are all linked, are done."""
    _, chosen = _weighed(members, None, level)
    kinds = {r["kind"]: r["n"] for r in chosen.groupBy("kind").agg(F.count("*").alias("n")).collect()}

    def of(kind: str, *columns: str) -> DataFrame:
        named = chosen.where(F.col("kind") == kind).select("node", *columns)
        return members.join(F.broadcast(named) if kinds[kind] <= BROADCAST_NODES else named, "node")

    nodes = materialise(_children(of("large"))) if "large" in kinds else None
    return nodes, of("small", "top", "out_parts", "in_parts") if "small" in kinds else None


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places that connect all whose sets are similar enough, by exact sizes of intersections.

    A pair is compared when either member starts. Members of the largest component so far wait, as the others meet
    them from their side; the end is when all that wait are in one component, so every pair that is not was compared.
    """
    size = np.array([len(x) for x in sets])
    each, number = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(number, kind="stable")
    posting = holder[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(each)))])
    begin = np.concatenate([[0], np.cumsum(size)])
    often = np.diff(start)[number]
    central = np.add.reduceat(often, begin[:-1]) / size
    label, out = np.arange(len(sets)), []
    waiting = np.ones(len(sets), bool)
    # the most central first: a group's common source links most of it at once
    order = np.argsort(-central, kind="stable")
    at = 0
    while True:
        count = np.bincount(label)
        while at < len(order) and count[label[order[at]]] == count.max() and count.max() > 1:
            at += 1
        if at < len(order):
            i = int(order[at])
            at += 1
        else:
            # those passed over: the component that most of them are in is left out, the first of the others starts
            late = order[waiting[order]]
            if not len(late):
                break
            held = np.bincount(label[late])
            late = late[label[late] != held.argmax()]
            if not len(late):
                break
            i = int(late[0])
        waiting[i] = False
        own = number[begin[i] : begin[i + 1]]
        length = start[own + 1] - start[own]
        flat = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start[own], length)
        both = np.bincount(posting[flat], minlength=len(sets))
        j = np.flatnonzero(100 * both >= percent * (size + size[i] - both))
        new, first = np.unique(label[j], return_index=True)
        first = first[new != label[i]]
        if len(first):
            out += [(i, k) for k in j[first].tolist()]
            label[np.isin(label, new)] = label[i]
    return out


def _confirm(blocks: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """True links (a, b): each member of a component of similar texts within a block, with the component's least."""
    small = blocks.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(blocks) if small else blocks, "id").select("block", "rep", "body", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for group in by_key(batches):
            sets: dict[int, np.ndarray] = {}
            for rep, body, text in zip(*(group.column(c).to_pylist() for c in ("rep", "body")), group.column("text").cast(pa.binary()).to_pylist(), strict=True):
                # a doc_id that repeats has other texts too
                if rep not in sets and len(x := shingles(text, known, width)) and digest(x) == body:
                    sets[rep] = x
            if len(sets) > 1:
                out = np.array(linked(list(sets.values()), percent), np.int64).reshape(-1, 2)
                if len(out):
                    rep = np.array(list(sets), np.int64)
                    ids, root = roots(rep[out[:, 0]], rep[out[:, 1]])
                    far = ids != root
                    yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], names=["a", "b"])

    return texts.repartition("block").sortWithinPartitions("block", "rep").mapInArrow(run, "a long, b long")


def _weighed(nodes: DataFrame, homes: DataFrame | None, level: int) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and what to do (``kind``) with the nodes that hold two components or more.

    Components are those of ``homes``, if given, else those that ``nodes`` has, else each member is one. Nodes that are
    no cell's work get a star (``large``); small ones are compared. Of small nodes with the same members one is kept.
    """
    mark = F.bit_xor(F.xxhash64("rep"))
    if homes is not None:
        nodes = _placed(nodes, homes)
    if "component" not in nodes.columns:
        nodes = nodes.withColumn("component", F.col("rep"))
        size = F.count("*")
        stats = nodes.groupBy("node").agg(
            size.alias("size"), F.sum("n").alias("weight"), mark.alias("mark"), (size.cast("double") * (size - 1) / 2).alias("pairs"), F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("most")
        )
    else:
        parts = nodes.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n").alias("weight"), mark.alias("mark"))
        c = F.col("c").cast("double")
        stats = parts.groupBy("node").agg(
            F.sum("c").alias("size"), F.sum("weight").alias("weight"), F.bit_xor("mark").alias("mark"), _pairs(c).alias("pairs"), F.max(F.struct("c", "component")).alias("w")
        )
        stats = stats.withColumn("top", F.col("w.component")).withColumn("most", F.col("w.c")).drop("w")
    fits = F.col("pairs") <= SMALL
    one = (F.col("size") <= PART) & (F.col("weight") <= PART_SHINGLES)
    # Few enough pairs are few members outside the largest component, at most the root of 2 * SMALL: they meet in one
    # cell unless their texts are long, and the others in parts no smaller than they are, so copies stay linear.
    outside = F.col("size") - F.col("most")
    parts = lambda n, part: F.greatest(F.ceil(n / part), F.ceil(F.col("weight") / PART_SHINGLES * n / F.col("size")), F.lit(1)).cast("int")
    part = F.when(fits, F.greatest(outside, F.lit(PART))).otherwise(F.lit(PART))
    stats = stats.where("pairs > 0").withColumn("kind", F.when(one | (F.col("size") == 2) | F.lit(level == LEVELS) | (fits & F.lit(level > 0)), "small").otherwise("large"))
    stats = stats.withColumn("top", F.when(~one, F.col("top"))).withColumn("out_parts", F.when(one, 1).otherwise(parts(outside, part)))
    stats = materialise(stats.withColumn("in_parts", F.when(F.col("top").isNotNull(), parts(F.col("most"), part)).otherwise(0)).drop("most", "pairs"))
    once = stats.where("kind = 'small'").groupBy("size", "mark").agg(F.min_by(F.struct(*(c for c in stats.columns if c not in ("size", "mark"))), "node").alias("s")).select("size", "mark", "s.*")
    return nodes, stats.where("kind <> 'small'").unionByName(once)


def _representatives(base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row for each different set: body, rep (its name), id (its smallest doc_id), n, first, sketch; and links
    between sets of one doc_id, or None if every doc_id has one set."""
    sets = base.where("body is not null and doc_id is not null")
    folded = sets.groupBy("body").agg(F.min(F.struct("doc_id", "n_shingles", "first", "sketch")).alias("r"))
    reps = folded.select("body", F.col("r.doc_id").alias("rep"), F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), F.col("r.first").alias("first"), F.col("r.sketch").alias("sketch"))
    several = materialise(sets.groupBy("doc_id").agg(F.min("body").alias("least"), F.max("body").alias("b")).where("least <> b").select("doc_id", "least"))
    if several.isEmpty():
        forget(several)
        return materialise(reps), None
    # The least set of a doc_id is named by it, others by their hash.
    reps = reps.join(several.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("rep", F.when(F.col("least").isNull() | (F.col("body") == F.col("least")), F.col("id")).otherwise(F.xxhash64("body")))
    reps = materialise(reps.select("body", "rep", "id", "n", "first", "sketch"))
    of = sets.select("doc_id", "body").join(several, "doc_id").select("doc_id", "body").distinct().join(reps.select("body", "rep"), "body")
    links = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    return reps, materialise(links)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_shingles, component_id: see the module."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialise(signed(docs, width))
    reps, same_id = _representatives(base)
    sketches = reps.select("rep", "id", "body", "sketch")
    nodes = reps.select("rep", "n", F.posexplode("first").alias("tree", "value")).select(F.xxhash64("tree", "value").alias("node"), "rep", "n")
    homes = None if same_id is None else materialise(components(same_id))
    last = kept = None
    for level in range(LEVELS + 1):
        kinds = {}
        if nodes is not None:
            nodes, chosen = _weighed(nodes, homes if level == 0 else None, level)
            kinds = {r["kind"]: r["n"] for r in chosen.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if not kinds and kept is None:
            break
        cells, blocks, large = [] if kept is None else [kept], [], None
        if "small" in kinds:
            small = chosen.where("kind = 'small'").select("node", "top", "out_parts", "in_parts")
            few = nodes.select("node", "rep", "component", "n").join(F.broadcast(small) if kinds["small"] <= BROADCAST_NODES else small, "node")
            cells.append(few.join(sketches, "rep"))
        if cells:
            blocks.append(_offers(_cells(cells[0] if len(cells) == 1 else cells[0].unionByName(cells[1])), percent))
        if "large" in kinds:
            large = _large(nodes, chosen, kinds["large"], sketches)
            blocks.append(_stars(large, kinds["large"], percent))
        offered = materialise((blocks[0] if len(blocks) == 1 else blocks[0].unionByName(blocks[1])).distinct())
        new = materialise(_confirm(offered, docs, width, percent))
        links = new if homes is None else new.unionByName(homes.select(F.col("id").alias("a"), F.col("component").alias("b")))
        old, homes = homes, materialise(components(links))
        forget(offered, new, old, nodes, last)
        if large is None:
            break
        last = _placed(large.select("node", "rep", "n", "id", "body", "sketch"), homes)
        forget(large)
        nodes, kept = _descend(last, level + 1)
    named = reps.select("body", "rep", "id")
    if homes is not None:
        named = named.join(homes.withColumnRenamed("id", "rep"), "rep", "left").select("body", "id", F.coalesce("component", "rep").alias("component"))
        if same_id is not None:
            # names of sets are not all doc_ids
            named = named.join(named.groupBy("component").agg(F.min("id").alias("least")), "component").select("body", F.col("least").alias("component"))
        named = named.select("body", "component")
    else:
        named = named.select("body", F.col("id").alias("component"))
    joined = base.select("doc_id", "n_shingles", "body").join(named, "body", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's components of ``documents``: 4-word shingles, similarity of 0.8 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
