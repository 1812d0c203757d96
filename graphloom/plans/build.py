"""From source files to the tables of a graph: nodes, edges, ranked neighbours, topology, communities and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routes, scalars
from ..model import with_defaults
from ..operators import community, joins, search, topology, writing
from ..operators.expand import capped
from ..session import cut
from ..sources import python_source, scip
from ..streaming import manifest

#: Lines of a search chunk.
CHUNK = 40


def routed(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``nodes`` with http_method and http_path of the handlers that the files name; decorators first."""
    functions = nodes.where("label = 'Function'")
    here = routes.decorated(files).select("path", F.col("handler").alias("bare"), F.struct("method", "route").alias("r1"))
    by_class = routes.falcon_methods(functions, routes.falcon(files)).select("path", "name", F.struct("method", "route").alias("r2"))
    named = routes.scripted(files).unionByName(routes.go(files)).withColumn("lang", scalars.language(F.col("path")))
    named = named.groupBy("lang", F.col("handler").alias("bare")).agg(F.min_by(F.struct("method", "route"), F.struct("path", "method", "route")).alias("r3"))
    keyed = functions.select("uid", "path", "name", "lang", F.substring_index("name", ".", -1).alias("bare"))
    found = keyed.join(here, ["path", "bare"], "left").join(by_class, ["path", "name"], "left").join(named, ["lang", "bare"], "left")
    found = found.select("uid", F.coalesce("r1", "r2", "r3").alias("r")).where("r is not null").select("uid", F.col("r.method").alias("http_method"), F.col("r.route").alias("http_path"))
    return nodes.drop("http_method", "http_path").join(found, "uid", "left").na.fill("", ["http_method", "http_path"])


def dispatched(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """source_uid, target_uid, line_number: task dispatches, from the last function that begins before the line."""
    functions = nodes.where("label = 'Function'")
    first = F.struct("path", "line_number", "uid")
    targets = functions.groupBy(F.substring_index("name", ".", -1).alias("target")).agg(F.min(first).alias("t"))
    sites = routes.dispatches(files).join(targets.select("target", F.col("t.uid").alias("target_uid")), "target")
    facts = functions.select("path", F.col("line_number").alias("line"), "uid")
    out = joins.preceding(sites, facts, ["path"], "line", F.struct("uid"), strict=True).where("found is not null")
    return out.select(F.col("found.uid").alias("source_uid"), "target_uid", F.col("line").alias("line_number")).where("source_uid <> target_uid").distinct()


def chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """id, path, start_line, end_line, text: every file in pieces of ``size`` lines, without a shuffle."""
    rows = files.select("path", F.split(F.coalesce("text", F.lit("")), r"\r?\n").alias("l"))
    starts = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size))
    piece = F.transform(starts, lambda i: F.struct((i * size + 1).alias("start_line"), F.least((i + 1) * size, F.size("l").cast("long")).alias("end_line"), F.array_join(F.slice("l", (i * size + 1).cast("int"), F.lit(size)), "\n").alias("text")))
    out = rows.select("path", F.explode(piece).alias("c")).select("path", "c.*")
    return out.withColumn("id", F.concat_ws(":", "path", "start_line"))


def _from_index(indexes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, info = cut(scip.occurrences(indexes)), cut(scip.symbols(indexes))
    known = cut(scip.nodes(found, info))
    lines = routes.lines(files)
    zero = F.lit(0).cast("long").alias("line_number")
    links = scip.calls(found, known, lines).select("source_uid", "target_uid", F.lit("CALLS").alias("relation"), "line_number")
    links = links.unionByName(scip.inherits(known, info).select("source_uid", "target_uid", F.lit("INHERITS").alias("relation"), zero))
    owner = known.where("label = 'Class'").select("path", F.col("name").alias("owner"), F.col("uid").alias("source_uid"))
    methods = known.where("label = 'Function' and instr(name, '.') > 0").select("path", F.regexp_extract("name", r"^(.*)\.[^.]+$", 1).alias("owner"), F.col("uid").alias("target_uid"))
    links = links.unionByName(methods.join(owner, ["path", "owner"]).select("source_uid", "target_uid", F.lit("CONTAINS").alias("relation"), zero))
    nodes = known.groupBy("uid").agg(*(F.min_by(c, "seq").alias(c) for c in ("label", "name", "path", "line_number", "end_line")))
    return nodes.withColumn("lang", scalars.language(F.col("path"))), links, scip.imports(found, lines)


def _from_syntax(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, judged, linked = python_source.graph(files)
    linked = linked.groupBy("src_path", "dst_path").agg(F.min("line").alias("line_number"))
    return nodes, judged.select("source_uid", "target_uid", "relation", "line_number"), linked


def neighbours(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, rank and attributes: calls with one row a pair (its first line), ranked by the neighbour's name.

    The ranks are stored, so that a traversal is one join a hop and its caps are filters that the scan sees.
    """
    pairs = calls.groupBy("src", "dst").agg(F.min(F.struct("line_number", "call_kind", "confidence")).alias("s")).select("src", "dst", "s.*")
    named = pairs.join(nodes.select(F.col("uid").alias("dst"), "name"), "dst")
    return capped(named, ["name", "dst"], None).select("src", "dst", "rank", "line_number", "call_kind", "confidence")


def assemble(files: DataFrame, indexes: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a graph over ``files`` (path, text). Of ``indexes`` (content), compiled ones, if there are any
    symbols in them; else syntax trees."""
    files = files.select("path", "text")
    compiled = False
    if indexes is not None:
        nodes, links, linked = _from_index(indexes, files)
        compiled = not nodes.isEmpty()
    if not compiled:
        nodes, links, linked = _from_syntax(files)
    nodes = cut(with_defaults(routed(nodes.dropDuplicates(["uid"]), files)))
    inferred = (F.col("relation") == "CALLS") & F.lit(not compiled)
    links = links.withColumns({"call_kind": F.when(inferred, "resolved").otherwise("local"), "confidence": F.when(inferred, "INFERRED").otherwise("EXTRACTED")})
    tasks = dispatched(nodes, files).withColumns({"relation": F.lit("CALLS"), "call_kind": F.lit("celery_dispatch"), "confidence": F.lit("EXTRACTED")})
    judged = cut(writing.classified(links.unionByName(tasks), nodes))
    edges = judged.where("drop_reason is null").select("source_uid", "target_uid", "relation", "line_number", "call_kind", "confidence").distinct()
    paths = files.select("path").withColumn("lang", scalars.language(F.col("path")))
    imports = cut(writing.import_reasons(linked, paths))
    written = imports.where("drop_reason is null").select("src_path", "dst_path", "line_number")
    calls = edges.where("relation = 'CALLS'").select(F.col("source_uid").alias("src"), F.col("target_uid").alias("dst"), "line_number", "call_kind", "confidence")
    calls = cut(calls)
    at = nodes.select("uid", "path")
    pairs = calls.join(at.select(F.col("uid").alias("src"), F.col("path").alias("sf")), "src").join(at.select(F.col("uid").alias("dst"), F.col("path").alias("df")), "dst")
    pairs = cut(pairs.where("sf <> df").select("sf", "df").distinct())
    metrics = cut(topology.foundational(topology.degrees(pairs, nodes.select("path").distinct())))
    entry = cut(topology.entries(metrics, nodes.where("http_method <> ''").select("path").distinct()))
    depth = cut(topology.depths(pairs, metrics, entry))
    label = cut(topology.adopted(pairs, metrics, topology.labelled(pairs, metrics, entry)))
    of_file = metrics.join(depth.select("path", "depth"), "path").join(label, "path", "left").join(entry.withColumn("is_entry", F.lit(True)), "path", "left").na.fill(False, ["is_entry"])
    slugs = topology.unique_slugs(label.select("seed"))
    cluster = F.when(F.col("is_foundational"), "foundational").otherwise(F.coalesce("cluster_id", F.lit("")))
    placed = cut(of_file.join(slugs, "seed", "left").withColumn("cluster_id", cluster))
    groups = cut(community.communities(calls.select("src", "dst"), nodes.select("uid")))
    stored = nodes.drop("community_id", "cluster_id").join(groups.select("uid", F.col("community_id").cast("string")), "uid", "left").join(placed.select("path", "cluster_id"), "path", "left").na.fill("", ["community_id", "cluster_id"])
    callee = nodes.select(F.col("uid").alias("dst"), F.col("name").alias("callee"))
    outward = calls.where(F.col("call_kind").isin(*topology.EFFECTS, topology.EXTERNAL)).join(at.withColumnRenamed("uid", "src"), "src").join(callee, "dst")
    down = written.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    pieces = cut(chunks(files))
    return {
        "nodes": stored,
        "edges": edges,
        "losses": writing.summary(judged.select("relation", "drop_reason").unionByName(imports.select(F.lit("IMPORTS").alias("relation"), "drop_reason"))),
        "files": paths,
        "sources": files,
        "imports": written,
        "callees": neighbours(calls, nodes),
        "callers": neighbours(calls.withColumnsRenamed({"src": "_d", "dst": "src"}).withColumnRenamed("_d", "dst"), nodes),
        "files_down": file_links(down, pairs.select(F.col("sf").alias("src"), F.col("df").alias("dst"))),
        "files_up": file_links(down.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pairs.select(F.col("df").alias("src"), F.col("sf").alias("dst"))),
        "topology": placed,
        "clusters": topology.clusters(label, metrics, depth).drop("cluster_id").join(slugs, "seed", "left").na.fill("foundational", ["cluster_id"]).join(topology.entry_symbols(label, entry, nodes), "seed", "left"),
        "shared": topology.shared_dependencies(label, pairs, metrics),
        "cluster_details": topology.details(label, entry, outward).join(slugs, "seed").drop("seed"),
        "communities": groups,
        "chunks": pieces,
        "postings": search.postings(pieces).repartitionByRange("term").sortWithinPartitions("term", "id"),
        "corpus": search.statistics(pieces),
        "manifest": manifest.snapshot(files),
    }


#: Neighbours of a file that a search of dependencies follows: imports come first.
IMPORTED, CALLED = 50, 30


def file_links(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst, kind, rank: the capped neighbours of every file, imports before calls."""
    a = capped(imports.distinct(), ["dst"], IMPORTED).withColumn("kind", F.lit("IMPORTS"))
    b = capped(calls.distinct(), ["dst"], CALLED).withColumn("rank", F.col("rank") + IMPORTED).withColumn("kind", F.lit("CALLS"))
    return a.unionByName(b).select("src", "dst", "kind", "rank")


def dependencies(start: DataFrame, found: DataFrame, top: int = 100) -> DataFrame:
    """position, src, dst, kind, transitive: of what a traversal from ``start`` (id) ``found``, every import, and
    called files where they are first found."""
    w = Window.partitionBy("dst").orderBy("depth", "key")
    first = found.withColumn("first", F.row_number().over(w) == 1).join(start.select(F.col("id").alias("dst"), F.lit(True).alias("home")), "dst", "left")
    kept = first.where((F.col("kind") == "IMPORTS") | (F.col("first") & F.col("home").isNull()))
    position = F.row_number().over(Window.orderBy("depth", "key"))
    return kept.orderBy("depth", "key").limit(top).select(position.alias("position"), "src", "dst", "kind", (F.col("depth") > 1).alias("transitive"))
