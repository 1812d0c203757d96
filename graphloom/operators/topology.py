"""Files as a graph: foundational files, entries, depths and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .community import components
from .expand import capped, levels, traverse
from .order import placed

UNREACHED = 999
#: Depth to which an entry's cluster reaches.
REACH = 4
# Kinds of calls that act outside the caller's own flow, and of calls that leave the repository.
EFFECTS, EXTERNAL = ("celery_dispatch", "signal_dispatch", "event_dispatch"), "external"


def degrees(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """path, indegree (distinct calling files) of every file."""
    counts = pairs.groupBy(F.col("df").alias("path")).agg(F.countDistinct("sf").alias("indegree"))
    return files.select("path").join(counts, "path", "left").na.fill(0, ["indegree"])


def foundational(degree: DataFrame) -> DataFrame:
    """``degree`` with is_foundational: called by max(3, 5 % of files) files or more."""
    n = degree.agg(F.count("*").alias("n"))  # one row
    least = F.greatest(F.lit(3), F.floor(F.col("n") * 0.05))
    return degree.crossJoin(F.broadcast(n)).withColumn("is_foundational", F.col("indegree") >= least).drop("n")


def is_test(path):
    """The fixed tests by which a path is a test file's."""
    p = F.lower(path)
    return p.contains("/tests/") | p.contains("/test/") | p.startswith("test") | p.rlike(r"(?:_test\.py|_spec\.ts|[.](?:test|spec)\.[tj]s)$")


def entries(metrics: DataFrame, handlers: DataFrame) -> DataFrame:
    """path: files of HTTP handlers, and files that nobody calls and that are neither foundational nor tests."""
    alone = metrics.where((F.col("indegree") == 0) & ~F.col("is_foundational") & ~is_test(F.col("path"))).select("path")
    return handlers.select("path").union(alone).distinct()


def depths(pairs: DataFrame, files: DataFrame, entry: DataFrame) -> DataFrame:
    """path, depth from the nearest entry; unreached files have 999."""
    found = levels(pairs.select(F.col("sf").alias("src"), F.col("df").alias("dst")), entry.select(F.col("path").alias("id")))
    return files.select("path").join(found.withColumnRenamed("id", "path"), "path", "left").na.fill(UNREACHED, ["depth"])


def labelled(pairs: DataFrame, metrics: DataFrame, entry: DataFrame) -> DataFrame:
    """path, seed: the entry whose search reaches the file first, entries in order of path, never through foundational files."""
    usual = metrics.where(~F.col("is_foundational")).select("path")
    inside = pairs.join(usual.select(F.col("path").alias("df")), "df", "left_semi").select(F.col("sf").alias("src"), F.col("df").alias("dst"))
    seeds = entry.join(usual, "path", "left_semi")
    roots = cut(placed(seeds.select(F.col("path").alias("id")), ["id"], "n").withColumn("n", F.col("n").cast("int")))
    emitted = traverse(capped(inside, ["dst"], None), roots.select("id", F.array("n").alias("key")), REACH)
    reached = roots.select(F.col("id").alias("path"), F.array("n").alias("key"), F.lit(0).alias("depth"))
    if emitted is not None:
        reached = reached.unionByName(emitted.select(F.col("dst").alias("path"), "key", "depth"))
    first = reached.groupBy("path").agg(F.min(F.struct("depth", "key")).alias("s"))
    return first.select("path", F.col("s.key")[0].alias("n")).join(roots.select("n", F.col("id").alias("seed")), "n").select("path", "seed")


def adopted(pairs: DataFrame, metrics: DataFrame, label: DataFrame) -> DataFrame:
    """``label`` with the other usual files: by vote (a called file counts 2, a calling file 1, ties to the first
    seed), in rounds that see the last round's result, until one finds none; what is left joins the largest cluster."""
    usual = metrics.where(~F.col("is_foundational")).select("path")
    known = cut(label)
    both = pairs.select(F.col("sf").alias("path"), F.col("df").alias("other"), F.lit(2).alias("w")).unionByName(pairs.select(F.col("df").alias("path"), F.col("sf").alias("other"), F.lit(1).alias("w")))
    while True:
        orphans = usual.join(known, "path", "left_anti")
        votes = both.join(orphans, "path", "left_semi").join(known.select(F.col("path").alias("other"), "seed"), "other")
        won = votes.groupBy("path", "seed").agg(F.sum("w").alias("w")).groupBy("path").agg(F.min_by("seed", F.struct(-F.col("w"), "seed")).alias("seed"))
        won = cut(won)
        if won.isEmpty():
            break
        known = cut(known.unionByName(won))
    largest = known.groupBy("seed").count().orderBy(F.desc("count"), "seed").limit(1).select("seed")
    rest = usual.join(known, "path", "left_anti").crossJoin(F.broadcast(largest))  # one row
    return known.unionByName(rest.select("path", "seed"))


def slug(path):
    found = F.substring(F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 64)
    return F.when(found == "", "cluster").otherwise(found)


def clusters(label: DataFrame, metrics: DataFrame, depth: DataFrame) -> DataFrame:
    """One row a cluster: id, number of files, depths (999 left out), mean in-degree. The foundational files are one
    that lies beyond all depths."""
    rows = label.unionByName(metrics.where("is_foundational").select("path", F.lit("foundational").alias("seed"))).join(metrics, "path").join(depth, "path")
    reached = F.when((F.col("depth") < UNREACHED) & ~F.col("is_foundational"), F.col("depth"))
    out = rows.groupBy("seed").agg(
        F.count("*").alias("files"),
        F.coalesce(F.min(reached), F.lit(UNREACHED)).alias("min_depth"),
        F.coalesce(F.max(reached), F.lit(0)).alias("max_depth"),
        F.round(F.avg("indegree"), 4).alias("avg_indegree"),
        F.max("is_foundational").alias("is_foundational"),
    )
    return out.join(unique_slugs(out.where("not is_foundational").select("seed")), "seed", "left").na.fill("foundational", ["cluster_id"])


def entry_symbols(label: DataFrame, entry: DataFrame, symbols: DataFrame) -> DataFrame:
    """seed, entry_symbols: the first four symbols (path, line_number, name) of a cluster's first three entry files,
    each name once, ten at most."""
    of_cluster = label.join(entry.select("path"), "path", "left_semi")
    first = of_cluster.withColumn("f", F.row_number().over(Window.partitionBy("seed").orderBy("path"))).where("f <= 3")
    in_file = Window.partitionBy("path").orderBy("line_number", "name")
    top = symbols.join(first, "path").withColumn("s", F.row_number().over(in_file)).where("s <= 4")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("f", "s", "name"))), lambda x: x["name"])
    return top.groupBy("seed").agg(F.slice(F.array_distinct(ordered), 1, 10).alias("entry_symbols"))


def shared_dependencies(label: DataFrame, pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """seed, path: the foundational files that a cluster's files call, a row each."""
    base = metrics.where("is_foundational").select(F.col("path").alias("df"))
    return pairs.join(base, "df", "left_semi").join(label.select(F.col("path").alias("sf"), "seed"), "sf").select("seed", F.col("df").alias("path")).distinct()


def unique_slugs(seeds: DataFrame) -> DataFrame:
    """seed, cluster_id: slugs of seeds in order of path; a repeated one's second is numbered one."""
    named = seeds.select("seed", slug(F.col("seed")).alias("base")).distinct()
    n = F.row_number().over(Window.partitionBy("base").orderBy("seed")) - 1
    return named.withColumn("n", n).select("seed", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws("-", F.substring("base", 1, 58), "n")).alias("cluster_id"))


def merged_by_overlap(members: DataFrame, least: float = 0.6) -> DataFrame:
    """a, b, jaccard: pairs of overlapping clusters (cluster, path).

    Clusters of n paths that overlap by ``least`` share one of the first n - ceil(least * n) + 1 of each, paths in
    order of how many clusters hold them; only these meet, so a path of many clusters is met last, if at all. What
    meets is then compared over all paths.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("n"))
    spread = members.groupBy("path").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("f", "path"))
    first = members.join(spread, "path").join(size, "cluster").withColumn("i", place)
    # a share that rounding puts just above a whole number is not raised to the next
    first = first.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).select("cluster", "path", "n")
    side = lambda c, n: first.select(F.col("cluster").alias(c), "path", F.col("n").alias(n))
    met = side("a", "na").join(side("b", "nb"), "path").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - 1e-9))
    met = met.select("a", "b", "na", "nb").distinct()
    shared = met.join(members.select(F.col("cluster").alias("a"), "path"), "a").join(members.select(F.col("cluster").alias("b"), "path"), ["b", "path"])
    counted = shared.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return counted.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard")).where(F.col("jaccard") >= least)


def united(members: DataFrame, least: float = 0.6) -> DataFrame:
    """``members`` (cluster, path) after overlapping clusters became one, named after the largest of them (ties to the
    least name), until no two overlap. Clusters that share no path stay as they are."""
    while True:
        pairs = cut(merged_by_overlap(members, least).select("a", "b"))
        if pairs.isEmpty():
            return members
        size = members.groupBy("cluster").agg(F.count("*").alias("n"))
        group = components(pairs).withColumnRenamed("uid", "cluster").join(size, "cluster")
        named = group.groupBy("component").agg(F.min_by("cluster", F.struct(-F.col("n"), "cluster")).alias("to"))
        to = group.select("cluster", "component").join(named, "component").select("cluster", "to")
        members = cut(members.join(to, "cluster", "left").select(F.coalesce("to", "cluster").alias("cluster"), "path").distinct())


def details(label: DataFrame, entry: DataFrame, calls: DataFrame) -> DataFrame:
    """seed, what, value: a row each for a cluster's files, entry files, side effects (kind:callee) and external
    calls, of ``calls`` (path of the caller, call_kind, callee)."""
    row = lambda rows, what, value: rows.select("seed", F.lit(what).alias("what"), value.alias("value"))
    out = row(label, "file", F.col("path")).unionByName(row(label.join(entry.select("path"), "path", "left_semi"), "entry_file", F.col("path")))
    named = calls.where("callee <> ''").join(label, "path")
    out = out.unionByName(row(named.where(F.col("call_kind").isin(*EFFECTS)), "side_effect", F.concat_ws(":", "call_kind", "callee")))
    return out.unionByName(row(named.where(F.col("call_kind") == EXTERNAL), "external_call", F.col("callee"))).distinct()
