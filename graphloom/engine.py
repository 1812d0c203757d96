"""A repository's graph as versions of Parquet tables in one folder, and the queries that users ask of it.

Building writes a new version beside the old one and then adds its number to ``versions``, so a reader sees a whole
graph or the one before, and a failed build leaves nothing behind that is read. Every query returns a DataFrame over
the stored tables; neighbours are stored ranked, so a hop is one join and no query sorts the graph.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import routes, scalars
from .model import EDGES, NODES
from .operators import evaluation, expand, joins, search
from .operators import export as drawing
from .operators.order import placed
from .plans import build
from .session import cut
from .sources import files as disk
from .sources import python_source
from .streaming import manifest

# Limits of answers.
TRACE_DEPTH, PATH_HOPS, FILE_DEPTH = 5, 20, 3
EDGES_SHOWN, PEERS, ENTRIES = 100, 10, 50
#: Order in which labels are looked at when a name is resolved.
PRIORITY = ("Function", "Class", "Interface", "Struct", "Enum", "Variable")


class NotIndexed(LookupError):
    """The store holds no graph yet."""


class CodeGraph:
    """The graph in ``store``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")

    # ---- building

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    @cached_property
    def _version(self) -> str:
        known = self._read(f"{self.store}/versions")
        last = known.orderBy(F.desc("n"), F.desc("name")).first() if known is not None else None
        if last is None:
            raise NotIndexed(self.store)
        return last["name"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/{self._version}/{name}")

    def write(self, files: DataFrame, indexes: DataFrame | None = None) -> DataFrame:
        """Build the graph of ``files`` (path, text) and make it the current version; returns the losses."""
        name = uuid.uuid4().hex
        for part, rows in build.assemble(files, indexes).items():
            rows.write.parquet(f"{self.store}/{name}/{part}")
        known = self._read(f"{self.store}/versions")
        n = 0 if known is None else known.agg(F.max("n")).first()[0] + 1
        self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(name).alias("name")).coalesce(1).write.mode("append").parquet(f"{self.store}/versions")
        self.__dict__.pop("_version", None)
        return self.table("losses")

    def index(self, root: str, indexes: DataFrame | None = None) -> DataFrame:
        """Build from the code files below ``root``."""
        return self.write(disk.repository(self.spark, root).select("path", "text"), indexes)

    def reindex(self, root: str, force: bool = False, indexes: DataFrame | None = None) -> dict:
        """Build anew if any file was added, changed or deleted since: state and counts of the files by change."""
        found = cut(disk.repository(self.spark, root).select("path", "text"))
        try:
            old = self.table("manifest")
        except NotIndexed:
            old = manifest.snapshot(found).where("false")
        counts = {r["state"]: r["count"] for r in manifest.changes(old, manifest.snapshot(found)).groupBy("state").count().collect()}
        if counts or force:
            self.write(found, indexes)
        return {"state": "updated" if counts or force else "up_to_date", **{k: counts.get(k, 0) for k in ("added", "changed", "deleted")}}

    def remove_file(self, path: str) -> int:
        """Make a version without a file: its symbols go, and every edge and import at them. Returns the symbols gone."""
        gone = self.table("nodes").where(F.col("path") == path).count()
        known = self.table("sources")
        if not known.where(F.col("path") == path).isEmpty():
            self.write(known.where(F.col("path") != path))
        return gone

    def clear(self) -> int:
        """Make an empty version; returns the symbols gone. Versions before it stay on disk until :meth:`prune`."""
        gone = self.table("nodes").count()
        self.write(self.table("sources").where("false"))
        return gone

    def prune(self, keep: int = 1) -> int:
        """Delete the tables of all but the last ``keep`` versions; readers of those must be done. Returns how many."""
        known = self._read(f"{self.store}/versions")
        rows = [] if known is None else known.orderBy(F.desc("n"), F.desc("name")).collect()  # a row a build
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(bool(fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{r['name']}"), True)) for r in rows[max(keep, 1) :])

    def stale(self) -> list[str]:
        """Columns of the schema that the stored tables lack."""
        want = {"nodes": NODES, "edges": EDGES}
        derived = {"seq", "source", "alias", "src_path", "dst_path"}  # not stored
        return [f"{t}.{c}" for t, schema in want.items() for c in disk.stale_columns(self.table(t), schema) if c not in derived]

    # ---- looking up

    def resolve_symbol(self, name: str, file: str = "") -> DataFrame:
        """The symbols that a name means: up to five exact ones of the first label that has any, else up to three
        that contain it. A method is known by its bare name too. ``file`` keeps symbols of paths that hold it."""
        known = self.table("nodes").where(F.col("label").isin(*PRIORITY))
        if file:
            known = known.where(F.col("path").contains(file))
        priority = F.array_position(F.array(*(F.lit(x) for x in PRIORITY)), F.col("label"))
        exact = (F.col("name") == name) | F.col("name").endswith(f".{name}")
        how = F.when(F.col("name") == name, 0).when(exact, 1).otherwise(2)
        hits = known.where(F.col("name").contains(name)).withColumns({"how": how, "p": priority})
        best = hits.agg(F.min(F.struct("how", "p")).alias("b"))  # one row
        kept = hits.crossJoin(F.broadcast(best)).where((F.struct("how", "p") == F.col("b")))
        ranked = kept.orderBy("name", "path", "line_number", "uid").limit(5)
        n = F.row_number().over(Window.orderBy("name", "path", "line_number", "uid"))
        out = ranked.withColumn("n", n).where((F.col("how") < 2) | (F.col("n") <= 3))
        return out.select("n", "uid", "label", "name", "path", "line_number", "end_line")

    def resolve_file(self, text: str) -> DataFrame:
        """The best file: the whole path, then the file name, then a part of the path."""
        p = F.col("path")
        how = F.when(p == text, 0).when(scalars.basename(p) == scalars.basename(F.lit(text)), 1).when(p.contains(text), 2)
        return self.table("files").withColumn("how", how).where("how is not null").orderBy("how", "path").limit(1).select("path", "lang")

    def _symbol(self, name: str, file: str = "") -> str:
        hit = self.resolve_symbol(name, file).orderBy("n").first()
        return hit["uid"] if hit else ""

    def _file(self, text: str) -> str:
        hit = self.resolve_file(text).first()
        return hit["path"] if hit else ""

    def _root(self, value: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(value).alias("id")).where("id <> ''")

    def symbol(self, uid: str) -> DataFrame:
        return self.table("nodes").where(F.col("uid") == uid)

    def list_symbols(self, file: str, top: int = 200) -> DataFrame:
        here = self.table("nodes").where(F.col("path") == self._file(file))
        return here.select("line_number", "label", "name", "end_line", "uid").orderBy("line_number", "label", "name", "uid").limit(top)

    def file_candidates(self, text: str, top: int = 20) -> DataFrame:
        """Symbols of the file that a text means, or of all files whose path holds the text or its stem."""
        known = self.table("nodes").where("label in ('Function', 'Class')")
        file, stem = self._file(text), text.rpartition("/")[2].rpartition(".")[0]
        here = F.col("path") == file if file else F.col("path").contains(text) | (F.col("path").contains(stem) if stem else F.lit(False))
        return known.where(here).select("path", "line_number", "label", "name", "uid").orderBy("path", "line_number", "label", "name", "uid").limit(top)

    def enclosing(self, places: DataFrame) -> DataFrame:
        """``places`` (path, line, ...) with the last symbol that begins at or before each."""
        facts = self.table("nodes").where("label in ('Function', 'Class')").select("path", F.col("line_number").alias("line"), "label", "name", "uid")
        # of two at one line, the function
        return joins.preceding(places, facts, ["path"], "line", F.struct("label", "name", "uid")).select(*places.columns, F.col("found.name").alias("symbol"), F.col("found.label").alias("symbol_kind"), F.col("found.uid").alias("uid"))

    def name_search(self, term: str, of_label: int = 25, top: int = 50) -> DataFrame:
        hits = self.table("nodes").where(scalars.contains_literally(F.col("name"), term))
        n = F.row_number().over(Window.partitionBy("label").orderBy("name", "path", "line_number", "uid"))
        return hits.withColumn("n", n).where(F.col("n") <= of_label).orderBy("label", "n").limit(top).select("label", "n", "name", "path", "line_number", "uid")

    # ---- traversal

    def _named(self, found: DataFrame) -> DataFrame:
        known = self.table("nodes")
        end = lambda side: known.select(F.col("uid").alias(side), F.struct("name", "path", "line_number").alias(f"{side}_at"))
        out = found.join(end("src"), "src").join(end("dst"), "dst")
        return out.select("position", "depth", "src", "src_at.name", "src_at.path", "dst", F.col("dst_at.name").alias("to_name"), F.col("dst_at.path").alias("to_path"), F.col("dst_at.line_number").alias("to_line"), "line_number", "call_kind", "confidence").orderBy("position")

    def _walk(self, table: str, root: str, depth: int, cap: int | None, top: int | None) -> DataFrame:
        edges = self.table(table)
        found = expand.traverse(edges if cap is None else edges.where(F.col("rank") <= cap), self._root(root), depth)
        if top is None:
            return self._named(placed(found, ["depth", "key"]))
        first = found.orderBy("depth", "key").limit(top)
        return self._named(first.withColumn("position", F.row_number().over(Window.orderBy("depth", "key")).cast("long")))

    def trace(self, symbol: str, direction: str = "callees", depth: int = 3, file: str = "") -> DataFrame:
        """The first hundred calls of a breadth-first search from a symbol; with ``callers``, src is the callee."""
        if direction not in ("callees", "callers"):
            raise ValueError(f"direction is callees or callers, not {direction}")
        return self._walk(direction, self._symbol(symbol, file), min(max(depth, 1), TRACE_DEPTH), 30, EDGES_SHOWN)

    def trace_report(self, symbol: str, direction: str = "callees", depth: int = 3, file: str = "") -> dict:
        """What :meth:`trace` finds from the first symbol of a name, or from the one whose path holds ``file``: root,
        found, chain (a hundred rows at most), truncated, and other symbols of the name as alternatives. For a name
        that no symbol has, the symbols of the file it means as candidates."""
        roots = self.resolve_symbol(symbol).orderBy("n").collect()
        if not roots:
            near = [r.asDict() for r in self.file_candidates(symbol).collect()]
            more = {"candidates": near, "message": "No symbol has this name; these are in the file that it means."} if near else {}
            return {"root": symbol, "found": False, "chain": [], **more}
        root = next((r for r in roots if file and file in r["path"]), roots[0])
        if direction not in ("callees", "callers"):
            raise ValueError(f"direction is callees or callers, not {direction}")
        chain = [r.asDict() for r in self._walk(direction, root["uid"], min(max(depth, 1), TRACE_DEPTH), 30, EDGES_SHOWN).collect()]
        out = {"root": root["name"], "root_file": root["path"], "root_line": root["line_number"], "direction": direction, "found": True, "chain": chain, "truncated": len(chain) >= EDGES_SHOWN}
        if others := [{"name": r["name"], "file": r["path"], "line": r["line_number"]} for r in roots if r["uid"] != root["uid"]]:
            out |= {"alternatives": others[:5], "note": "Several symbols have this name; a part of the path as file chooses among them."}
        return out

    def who_calls(self, symbol: str, depth: int = 1) -> DataFrame:
        """All callers up to a depth, without caps; src is the callee."""
        return self._walk("callers", self._symbol(symbol), max(depth, 1), None, None)

    def find_path(self, start: str, goal: str, hops: int = 15) -> DataFrame:
        """hop, uid, name, path, line_number of the first shortest chain of calls; no rows where there is none."""
        a, b = self._symbol(start), self._symbol(goal)
        edges = self.table("callees").where("rank <= 30").select("src", "dst", "rank")
        found = expand.shortest_path(edges if a and b else edges.where("false"), a, b, min(max(hops, 1), PATH_HOPS))
        return found.withColumnRenamed("id", "uid").join(self.table("nodes").select("uid", "name", "path", "line_number"), "uid").orderBy("hop").select("hop", "uid", "name", "path", "line_number")

    def dependencies(self, file: str, direction: str = "imports", depth: int = 2) -> DataFrame:
        """Files that a file imports or calls, or with ``imported_by`` those that import or call it."""
        links = self.table({"imports": "files_down", "imported_by": "files_up"}[direction])
        start = self._root(self._file(file))
        return build.dependencies(start, expand.traverse(links, start, min(max(depth, 1), FILE_DEPTH)), EDGES_SHOWN)

    def dependencies_report(self, file: str, direction: str = "imports", depth: int = 2) -> dict:
        """What :meth:`dependencies` finds: file, direction, depth, deps (a hundred at most), dep_count, truncated."""
        deps = [r.asDict() for r in self.dependencies(file, direction, depth).collect()]
        return {"file": self._file(file), "direction": direction, "depth": min(max(depth, 1), FILE_DEPTH), "deps": deps, "dep_count": len(deps), "truncated": len(deps) >= EDGES_SHOWN}

    def execution_chain(self, symbol: str, depth: int = 4, file: str = "") -> DataFrame:
        """Every call reached from a symbol, in order."""
        return self._walk("callees", self._symbol(symbol, file), depth, None, None)

    def files_in_chain(self, symbol: str, depth: int = 4, file: str = "") -> DataFrame:
        """Files of an execution chain, in order of first use."""
        return self.execution_chain(symbol, depth, file).groupBy(F.col("to_path").alias("path")).agg(F.min("position").alias("position")).orderBy("position")

    # ---- structure

    def context(self, what: str) -> DataFrame:
        """One row: a file's or symbol's cluster, depth, in-degree, community, related files and peers.

        Related files are of the same cluster, the nearest to an entry first; peers are members of the community in
        other files.
        """
        symbol = self._symbol(what)
        file = self._file(what) if not symbol else self.symbol(symbol).first()["path"]
        places = self.table("topology")
        here = places.where(F.col("path") == file).select("path", "cluster_id", "depth", "indegree", "is_foundational", "is_entry")
        members = self.table("communities").join(self.table("nodes").select("uid", "name", "path", "line_number"), "uid")
        mine = members.where(F.col("uid") == symbol) if symbol else members.where(F.col("path") == file)
        home = mine.groupBy("community_id").count().orderBy(F.desc("count"), "community_id").limit(1).select("community_id")
        few = lambda rows, c: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), ",").alias("v"))
        near = places.join(here.select("cluster_id"), "cluster_id", "left_semi").where(F.col("path") != file).orderBy("depth", "path").limit(PEERS)
        related = few(near.withColumn("n", F.row_number().over(Window.orderBy("depth", "path"))), "path").withColumnRenamed("v", "related")
        others = members.join(home, "community_id", "left_semi").where(F.col("path") != file).orderBy("uid").limit(PEERS + 1)
        shown = others.withColumn("n", F.row_number().over(Window.orderBy("uid")))
        peers = few(shown.where(F.col("n") <= PEERS), "name").withColumnRenamed("v", "peers")
        more = shown.agg((F.count("*") > PEERS).alias("peers_truncated"))
        row = self._root(file).select(F.col("id").alias("path")).join(here, "path", "left")
        for one in (home.agg(F.max("community_id").alias("community_id")), related, peers, more):
            row = row.crossJoin(F.broadcast(one))  # one row each
        return row

    def handlers(self) -> DataFrame:
        return self.table("nodes").where("http_method <> ''").select("http_method", "http_path", "name", "path", "line_number").orderBy("path", "line_number")

    def task_dispatches(self) -> DataFrame:
        known = self.table("nodes")
        calls = self.table("edges").where("call_kind = 'celery_dispatch'").select("source_uid", "target_uid", F.col("line_number").alias("line"))
        out = calls.join(known.select(F.col("uid").alias("source_uid"), F.col("name").alias("caller"), "path"), "source_uid")
        return out.join(known.select(F.col("uid").alias("target_uid"), F.col("name").alias("task")), "target_uid").select("path", "line", "caller", "task").orderBy("path", "line")

    def entry_points(self, kind: str = "all") -> DataFrame:
        """kind, path, symbols: files of routes (http), of dispatched tasks (tasks) and entries of clusters
        (topology), with their first five symbols; fifty rows, and a row of kind ``truncation_notice`` if there are
        more. Without any of them, all files at depth 0 that nobody calls (indegree_zero)."""
        known = self.table("nodes")
        tasks = self.table("edges").where("call_kind = 'celery_dispatch'").select(F.col("target_uid").alias("uid"))
        sets = {
            "http": known.where("http_method <> ''").select("path"),
            "tasks": known.join(tasks, "uid", "left_semi").select("path"),
            "topology": self.table("topology").where("is_entry").select("path"),
        }
        every = None
        for name, rows in sets.items():
            if kind in ("all", name):
                part = rows.distinct().withColumn("kind", F.lit(name))
                every = part if every is None else every.unionByName(part)
        if every is None:
            raise ValueError(f"kind is all, {', '.join(sets)}; not {kind}")
        every = cut(every)
        total = every.count()
        if kind == "all" and not total:
            every = self.table("topology").where("depth = 0 and indegree = 0").select("path", F.lit("indegree_zero").alias("kind"))
        shown = every.orderBy("kind", "path").limit(ENTRIES)
        n = F.row_number().over(Window.partitionBy("path").orderBy("line_number", "name"))
        top = known.join(shown, "path", "left_semi").withColumn("n", n).where("n <= 5").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("s"))
        out = shown.join(top, "path", "left").select("kind", "path", F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("symbols"))
        if total > ENTRIES:
            out = out.unionByName(self._root("-").select(F.lit("truncation_notice").alias("kind"), F.lit("").alias("path"), F.lit(f"{ENTRIES} of {total}").alias("symbols")))
        return out.orderBy(F.col("kind") == "truncation_notice", "kind", "path")

    def status(self) -> DataFrame:
        """what, name, n: nodes by label, edges by relation, the twenty first clusters, the five largest communities."""
        of = lambda rows, what, name, n=F.count("*"): rows.groupBy(name.cast("string").alias("name")).agg(n.cast("long").alias("n")).select(F.lit(what).alias("what"), "name", "n")
        clusters = self.table("clusters").orderBy("is_foundational", "min_depth", F.desc("files"), "cluster_id").limit(20)
        groups = self.table("communities").groupBy("community_id").count().orderBy(F.desc("count"), "community_id").limit(5)
        out = of(self.table("nodes"), "nodes", F.col("label")).unionByName(of(self.table("edges"), "edges", F.col("relation")))
        out = out.unionByName(self.table("imports").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("edges").alias("what"), F.lit("IMPORTS").alias("name"), "n"))
        out = out.unionByName(of(clusters, "cluster", F.col("cluster_id"), F.sum("files"))).unionByName(of(groups, "community", F.col("community_id"), F.sum("count")))
        return out.orderBy("what", F.desc("n"), "name")

    def call_stats(self) -> DataFrame:
        """total, local, external: call sites within a file and across files."""
        at = self.table("nodes").select("uid", "path")
        calls = self.table("edges").where("relation = 'CALLS'").join(at.select(F.col("uid").alias("source_uid"), F.col("path").alias("a")), "source_uid").join(at.select(F.col("uid").alias("target_uid"), F.col("path").alias("b")), "target_uid")
        return calls.agg(F.count("*").alias("total"), F.count_if(F.col("a") == F.col("b")).alias("local"), F.count_if(F.col("a") != F.col("b")).alias("external"))

    def tree(self) -> DataFrame:
        """path, folder, lang, symbols of every file."""
        count = self.table("nodes").groupBy("path").agg(F.count("*").alias("symbols"))
        return self.table("files").join(count, "path", "left").na.fill(0, ["symbols"]).select("path", scalars.parent(F.col("path")).alias("folder"), "lang", "symbols").orderBy("path")

    def snippet(self, uid: str, lines: int = 25) -> DataFrame:
        """uid, name, path, snippet: the first lines of a symbol."""
        one = self.symbol(uid).select("uid", "name", "path", "line_number", "end_line")
        joined = self.table("sources").join(F.broadcast(one), "path")  # one row
        n = F.least(F.greatest(F.col("end_line") - F.col("line_number") + 1, F.lit(1)), F.lit(lines)).cast("int")
        return joined.select("uid", "name", "path", F.array_join(F.slice(F.split("text", r"\r?\n"), F.col("line_number").cast("int"), n), "\n").alias("snippet"))

    def export(self, symbols: int = drawing.SYMBOLS, files: int = drawing.FILES) -> tuple[DataFrame, DataFrame]:
        """Nodes and links of the most called symbols and the files of the most symbols, for drawing."""
        return drawing.drawn(self.table("nodes"), self.table("edges"), self.table("imports"), symbols, files)

    def web_graph(self, symbols: int = drawing.SYMBOLS, files: int = drawing.FILES) -> dict:
        """What :meth:`export` finds as lists of nodes and links, with stats; at most ``symbols`` + ``files`` nodes."""
        nodes, links = self.export(symbols, files)
        every = self.table("nodes").where(F.col("label").isin(*drawing.LABELS)).count()
        by = lambda rows, *c: [r.asDict() for r in rows.orderBy(*c).collect()]
        return {"nodes": by(nodes, "kind", F.desc("weight"), "id"), "links": by(links, "relation", "source", "target"), "stats": drawing.counts(nodes, links, every)}

    def node_detail(self, uid: str) -> dict:
        """A symbol with its snippet, its callers and its callees, thirty of each in order of name; empty if there is none."""
        one = self.snippet(uid).first()
        if one is None:
            return {}
        known = self.table("nodes").select(F.col("uid").alias("dst"), "name", "path", "line_number")

        def of(table: str) -> list[dict]:
            next_to = self.table(table).where((F.col("src") == uid) & (F.col("rank") <= 30)).select("dst", "rank").join(known, "dst")
            return [r.asDict() for r in next_to.orderBy("rank").select(F.col("dst").alias("uid"), "name", "path", "line_number").collect()]

        return one.asDict() | {"callers": of("callers"), "callees": of("callees")}

    def cluster(self, cluster_id: str) -> DataFrame:
        """what, value: a cluster's files, entry files, side effects, external calls and the foundational files it uses."""
        own = self.table("cluster_details").where(F.col("cluster_id") == cluster_id).select("what", "value")
        if cluster_id == "foundational":
            own = self.table("topology").where("is_foundational").select(F.lit("file").alias("what"), F.col("path").alias("value"))
        seed = self.table("clusters").where(F.col("cluster_id") == cluster_id).select("seed")
        shared = self.table("shared").join(F.broadcast(seed), "seed", "left_semi").select(F.lit("shared_dependency").alias("what"), F.col("path").alias("value"))  # one row
        return own.unionByName(shared).orderBy("what", "value")

    def missing(self) -> DataFrame:
        """Suffixes of code files that gave no symbol."""
        return python_source.unseen_suffixes(self.table("files"), self.table("nodes"))

    # ---- search

    def _hits(self, queries: DataFrame, top: int, signs: int) -> DataFrame:
        pieces = self.table("chunks")
        stored = self._read(f"{self.store}/{self._version}/postings")  # a store of an older version has none
        found = search.bm25(pieces.select("id", "text"), queries, top) if stored is None else search.bm25_of_postings(stored, self.table("corpus"), queries, top)
        ranked = search.tiers(found)
        rows = ranked.join(pieces, "id").withColumn("line", F.col("start_line").cast("long"))
        inside = self.table("nodes").where("label in ('Function', 'Class')").select("path", "line_number", F.struct("line_number", "name", "label").alias("s"))
        # the symbol around the chunk's first line, or the first one that begins in it
        begin = rows.select("id", "path", "start_line", "end_line").distinct().join(inside, "path").where("line_number between start_line and end_line").groupBy("id").agg(F.min("s").alias("s"))
        named = self.enclosing(rows.select("qid", "rank", "id", "path", "line", "end_line", "score", "tier", F.substring("text", 1, signs).alias("snippet")))
        out = named.join(begin, "id", "left")
        return out.select(
            "qid",
            "rank",
            F.col("path").alias("file"),
            F.col("line").alias("start_line"),
            "end_line",
            F.coalesce("symbol", "s.name").alias("symbol"),
            F.coalesce("symbol_kind", "s.label").alias("symbol_kind"),
            "snippet",
            F.round("score", 4).alias("score"),
            "tier",
            scalars.language(F.col("path")).alias("language"),
        )

    def search(self, query: str, top: int = 10) -> DataFrame:
        """The best chunks for a text, with the symbols they belong to."""
        asked = self.spark.range(1).select(F.lit(0).alias("qid"), F.lit(query).alias("text"))
        return self._hits(asked, top, 1000).drop("qid").orderBy("rank")

    def related(self, file: str, line: int, top: int = 5) -> DataFrame:
        """Chunks that share the most telling terms with the chunk at a place, itself left out."""
        here = self.table("chunks").where((F.col("path") == self._file(file)) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
        asked = here.select(F.lit(0).alias("qid"), "text")
        own = here.select(F.col("path").alias("file"), F.col("start_line").cast("long").alias("start_line"))
        return self._hits(asked, top + 1, 1000).join(own, ["file", "start_line"], "left_anti").drop("qid").orderBy("rank").limit(top)

    def evaluate(self, truth: DataFrame, top: int = 10) -> DataFrame:
        """qid, query_type, ndcg, mrr, precision, symbol_mrr of a ground truth: id, query, relevant_files,
        relevant_symbols, query_type. A result is credited to the first relevant file that its path ends with or holds."""
        hits = cut(self._hits(truth.select(F.col("id").alias("qid"), F.col("query").alias("text")), top, 1000))
        wanted = truth.select(F.col("id").alias("qid"), F.posexplode("relevant_files").alias("n", "want"))
        met = hits.join(wanted, "qid", "left").withColumn("hit", evaluation.relevant_path(F.col("file"), F.col("want")))
        ranked = met.groupBy("qid", "rank", "file").agg(F.min_by("want", F.when(F.col("hit"), F.col("n"))).alias("want")).select("qid", F.coalesce("want", "file").alias("id"), "rank")
        asked = truth.select(F.col("id").alias("qid"), "query_type")
        relevant = wanted.select("qid", F.col("want").alias("id"))
        good = evaluation.metrics(ranked, relevant, asked, top).drop("precision")
        precision = evaluation.metrics(ranked, relevant, asked, 3).select("qid", "precision")
        symbols = evaluation.symbol_mrr(hits.select("qid", "rank", "snippet"), truth.select(F.col("id").alias("qid"), F.col("relevant_symbols").alias("symbols")))
        return asked.join(good, "qid").join(precision, "qid").join(symbols, "qid").orderBy("qid")

    def lines(self, file: str) -> DataFrame:
        """path, line, text of a file of the graph; other files are never read."""
        return routes.lines(self.table("sources").where(F.col("path") == self._file(file))).orderBy("line")
