"""Lookups, lists, joins and write accounting: queries over the projected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import GRAPH_SQL, RAW_SQL, SYMBOLS_SQL, dense_calls, last_by, raw_calls, symbols
from ..operators import export, joins, search, writing
from ..operators.expand import capped
from ..streaming import manifest

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


@query(f"""{GRAPH_SQL} select uid, name, path, label, cast(count(*) as bigint) as indegree from calls join sym on k = dst
group by uid, name, path, label order by indegree desc, name, path, uid limit 20""")
def q_top_indegree(spark: SparkSession, sf: str) -> DataFrame:
    """The most called symbols; calls are grouped by key before they meet the names."""
    counts = dense_calls(spark, sf).groupBy(F.col("dst").alias("k")).agg(F.count("*").alias("indegree"))
    return first_rows(symbols(spark, sf).join(counts, "k").select("uid", "name", "path", "label", "indegree"), 20, F.desc("indegree"), "name", "path", "uid")


@query(f"""{GRAPH_SQL} select src, dst, name, rank from (
  select src, dst, name, cast(row_number() over (partition by src order by name, uid) as integer) as rank from calls join sym on k = dst) where rank <= 30""")
def q_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Every function's first thirty callees."""
    named = dense_calls(spark, sf).join(symbols(spark, sf).select(F.col("k").alias("dst"), "name", "uid"), "dst")
    return capped(named, ["name", "uid"], 30).select("src", "dst", "name", "rank")


@query(f"""with {SYMBOLS_SQL}, {RAW_SQL}, j as (
  select case when src is null then 'src-missing' when dst is null then 'dst-missing' when a.k is null or b.k is null then 'unresolved-external'
    when a.label = 'Function' and b.label in ('Function', 'Class') or a.label = 'Class' and b.label = 'Function' then null else 'no-label-pair' end as r
  from (select src, case when l_suppkey % 37 = 0 then 'X' || l_suppkey else dst end as dst from raw) e left join sym a on a.k = src left join sym b on b.k = dst)
select coalesce(r, 'written') as outcome, cast(count(*) as bigint) as n from j group by 1""")
def q_write_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of every extracted call."""
    nodes = symbols(spark, sf).select(F.col("k").alias("uid"), "label")
    edges = raw_calls(spark, sf).select(F.col("src").alias("source_uid"), F.when(F.col("l_suppkey") % 37 == 0, F.concat(F.lit("X"), "l_suppkey")).otherwise(F.col("dst")).alias("target_uid"), F.lit("CALLS").alias("relation"))
    return writing.classified(edges, nodes).groupBy(F.coalesce("drop_reason", F.lit("written")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""with {SYMBOLS_SQL}, {RAW_SQL}, e as (
  select 'CALLS' as relation, src as s, dst as d from raw where src <> dst
  union all select 'INHERITS', 'S' || s_suppkey, 'P' || s_suppkey from supplier
  union all select 'IMPLEMENTS', 'P' || p_partkey, 'S' || p_size from part), j as (
  select relation, a.label as x, b.label as y from e left join sym a on a.k = s left join sym b on b.k = d), w as (
  select relation, x is not null and y is not null and (relation = 'CALLS' and (x = 'Function' and y in ('Function', 'Class') or x = 'Class' and y = 'Function')
    or relation = 'INHERITS' and (x = 'Class' and y in ('Class', 'Interface') or x = 'Interface' and y = 'Interface' or x = 'Struct' and y = 'Struct')
    or relation = 'IMPLEMENTS' and x in ('Class', 'Struct') and y = 'Interface') as ok from j)
select relation, cast(count(*) as bigint) as extracted, cast(count(*) filter (ok) as bigint) as persisted, cast(count(*) filter (not ok) as bigint) as dropped,
  count(*) filter (ok) = 0 as warning from w group by relation""")
def q_ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted, persisted and dropped edges of each relation, and relations lost as a whole."""
    nodes = symbols(spark, sf).select(F.col("k").alias("uid"), "label")
    supplier, part = spark.read.parquet(f"{sf}/supplier.parquet"), spark.read.parquet(f"{sf}/part.parquet")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    edges = raw_calls(spark, sf).where("src <> dst").select(F.col("src").alias("source_uid"), F.col("dst").alias("target_uid"), F.lit("CALLS").alias("relation"))
    edges = edges.unionByName(supplier.select(key("S", "s_suppkey").alias("source_uid"), key("P", "s_suppkey").alias("target_uid"), F.lit("INHERITS").alias("relation")))
    edges = edges.unionByName(part.select(key("P", "p_partkey").alias("source_uid"), key("S", "p_size").alias("target_uid"), F.lit("IMPLEMENTS").alias("relation")))
    return writing.summary(writing.classified(edges, nodes))


@query(f"{GRAPH_SQL} select call_kind, confidence, cast(count(*) as bigint) as n, cast(sum(line_number) as bigint) as line_sum from calls group by 1, 2")
def q_merged_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls as upserts leave them, the last writer's attributes."""
    return dense_calls(spark, sf).groupBy("call_kind", "confidence").agg(F.count("*").alias("n"), F.sum("line_number").alias("line_sum"))


@query("""with d as (select 'n' || (doc_id % 97) as name, '/d/' || source || '.md' as path, cast(doc_id % 97 as bigint) as line, doc_id as seq, coalesce(lang, '') as lang from documents),
r as (select *, row_number() over (partition by md5(name || '::' || path || '::' || cast(line as varchar)) order by seq desc) as k from d)
select md5(name || '::' || path || '::' || cast(line as varchar)) as uid, name, path, lang, seq from r where k = 1""")
def q_upserted_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Node identity by hash; of the writes of one identity the last stays."""
    from ..model import uid

    line = F.col("doc_id") % 97
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("n"), line).alias("name"), F.concat(F.lit("/d/"), "source", F.lit(".md")).alias("path"), line.alias("line"), F.col("doc_id").alias("seq"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = docs.withColumn("uid", uid(F.col("name"), F.col("path"), F.col("line")))
    return last_by(rows, ["uid"], [F.col("seq")]).select("uid", "name", "path", "lang", "seq")


@query(f"""with {SYMBOLS_SQL} select path, regexp_replace(path, '/[^/]*$', '') as directory, substr(path, 7) as relative, regexp_extract(path, '([^/]+)$', 1) as file,
  regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') as stem, 'python' as lang, arg_min(name, line_number * 1000000 + length(name)) as first_symbol, cast(count(*) as bigint) as symbols from sym
group by path""".replace("arg_min(name, line_number * 1000000 + length(name))", "(list(name order by line_number, name))[1]"))
def q_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files synthesised from symbols, with folder, relative path, language and first symbol."""
    p = F.col("path")
    found = symbols(spark, sf).groupBy("path").agg(F.min_by("name", F.struct("line_number", "name")).alias("first_symbol"), F.count("*").alias("symbols"))
    return found.select("path", scalars.parent(p).alias("directory"), scalars.relative(p, "/repo").alias("relative"), scalars.basename(p).alias("file"), scalars.stem(p).alias("stem"), scalars.language(p).alias("lang"), "first_symbol", "symbols")


@query(f"""{GRAPH_SQL} select * from (select 'node' as kind, label as name, cast(count(*) as bigint) as n from sym group by label
union all select 'edge', call_kind, count(*) from calls group by call_kind union all select 'edge', 'CONTAINS', count(*) from sym union all select 'file', 'File', count(distinct path) from sym)""")
def q_status(spark: SparkSession, sf: str) -> DataFrame:
    """Q10, A1, A2: counts of nodes by label and of edges by relation."""
    known = symbols(spark, sf)
    count = F.count("*").alias("n")
    out = known.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(count)
    out = out.unionByName(dense_calls(spark, sf).groupBy(F.lit("edge").alias("kind"), F.col("call_kind").alias("name")).agg(count))
    out = out.unionByName(known.agg(count).select(F.lit("edge").alias("kind"), F.lit("CONTAINS").alias("name"), "n"))
    return out.unionByName(known.agg(F.countDistinct("path").alias("n")).select(F.lit("file").alias("kind"), F.lit("File").alias("name"), "n"))


@query(f"""with {SYMBOLS_SQL} select label, substr(path, 1, 10) as area, cast(count(*) as bigint) as n from sym group by rollup(label, substr(path, 1, 10))""")
def q_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols by label and area, with subtotals."""
    return symbols(spark, sf).withColumn("area", F.substring("path", 1, 10)).rollup("label", "area").agg(F.count("*").alias("n"))


_PRIORITY = "case label when 'Function' then 0 when 'Class' then 1 when 'Interface' then 2 when 'Struct' then 3 when 'Enum' then 4 else 5 end"


@query(f"""with {SYMBOLS_SQL}, q as (select distinct n as q from (select name as n from sym union all select substr(name, 1, 4) from sym)), e as (
  select q, uid, label, name, path, line_number, {_PRIORITY} as p from q join sym on name = q), eb as (
  select *, cast(row_number() over (partition by q order by name, path, line_number, uid) as integer) as r from (select *, min(p) over (partition by q) as b from e) where p = b), c as (
  select q, uid, label, name, path, line_number, {_PRIORITY} as p from q join sym on contains(name, q) where q not in (select q from e)), cb as (
  select *, cast(row_number() over (partition by q order by name, path, line_number, uid) as integer) as r from (select *, min(p) over (partition by q) as b from c) where p = b)
select q, 'exact' as how, r, uid, label, name from eb where r <= 5 union all select q, 'contains', r, uid, label, name from cb where r <= 3""")
def q_resolve_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Names to symbols: exact matches of the first label that has any, else names that contain it.

    Substring search is an equi-join too: on the rarest piece of an asked text.
    """
    known = symbols(spark, sf).withColumn("p", F.expr(_PRIORITY)).select("uid", "label", "name", "path", "line_number", "p")
    asked = known.select(F.col("name").alias("q")).union(known.select(F.substring("name", 1, 4))).distinct()

    def of(pairs: DataFrame, how: str, n: int) -> DataFrame:
        best = pairs.withColumn("b", F.min("p").over(Window.partitionBy("q"))).where("p = b")
        ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("name", "path", "line_number", "uid")))
        return ranked.where(F.col("r") <= n).select("q", F.lit(how).alias("how"), "r", "uid", "label", "name")

    exact = known.join(asked, F.col("name") == F.col("q"))
    rest = asked.join(known.select(F.col("name").alias("q")).distinct(), "q", "left_anti")
    holding = search.holding(rest, known).join(known, "name")
    return of(exact, "exact", 5).unionByName(of(holding, "contains", 3))


@query(f"""with {SYMBOLS_SQL}, f as (select distinct path from sym), q as (select path as q from f union select regexp_extract(path, '([^/]+)$', 1) from f union select substr(path, 7, 6) from f), m as (
  select q, path, case when path = q then 0 when regexp_extract(path, '([^/]+)$', 1) = q then 1 else 2 end as w from q join f on contains(path, q))
select q, (list(path order by w, path))[1] as path from m group by q""")
def q_resolve_file(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: a path, a file name or a part of a path to the best file."""
    files = symbols(spark, sf).select("path").distinct()
    p = F.col("path")
    asked = files.select(p.alias("q")).union(files.select(scalars.basename(p))).union(files.select(F.substring("path", 7, 6))).distinct()
    # whole paths and names by equality; parts by their rarest piece
    equal = files.join(asked, p == F.col("q")).select("q", "path", F.lit(0).alias("w")).unionByName(files.join(asked, scalars.basename(p) == F.col("q")).select("q", "path", F.lit(1).alias("w")))
    rest = asked.join(equal.select("q").distinct(), "q", "left_anti")
    part = search.holding(rest, files.select(p.alias("name"))).select("q", F.col("name").alias("path"), F.lit(2).alias("w"))
    return equal.unionByName(part).groupBy("q").agg(F.min_by("path", F.struct("w", "path")).alias("path"))


@query(f"with {SYMBOLS_SQL} select path, name, label, line_number, cast(row_number() over (partition by path order by line_number, label, name, uid) as integer) as n from sym qualify n <= 200")
def q_list_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Q4, O3: symbols of every file in order."""
    w = Window.partitionBy("path").orderBy("line_number", "label", "name", "uid")
    return symbols(spark, sf).select("path", "name", "label", "line_number", F.row_number().over(w).alias("n")).where("n <= 200")


_PROBES = "probe as (select c.src, c.dst, a.path, a.line_number + c.line_number as line from calls c join sym a on a.k = c.src)"


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return dense_calls(spark, sf).join(symbols(spark, sf).select(F.col("k").alias("src"), "path", F.col("line_number").alias("at")), "src").select("src", "dst", "path", (F.col("at") + F.col("line_number")).alias("line"))


@query(f"""{GRAPH_SQL}, {_PROBES}, m as (select p.src, p.dst, p.path, p.line, s.uid, s.name, row_number() over (partition by p.src, p.dst order by s.line_number desc, (s.label = 'Function') desc, s.uid desc) as n
  from probe p join sym s on s.path = p.path and s.line_number <= p.line and s.label in ('Function', 'Class'))
select p.src, p.dst, p.line, m.uid, m.name from probe p left join m on m.src = p.src and m.dst = p.dst and m.n = 1""")
def q_enclosing_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Each call site's nearest preceding function or class, an as-of join in one shuffle."""
    facts = symbols(spark, sf).where("label in ('Function', 'Class')").withColumn("line", F.col("line_number"))
    payload = F.struct(F.col("line_number"), (F.col("label") == "Function").alias("f"), "uid", "name")
    found = joins.preceding(_probes(spark, sf), facts, ["path"], "line", payload)
    return found.select("src", "dst", "line", "found.uid", "found.name")


@query(f"""{GRAPH_SQL}, {_PROBES}, span as (select s.path, s.uid, s.line_number as a, s.line_number + p_size % 6 as b, p_partkey as seq from sym s join part on s.k = 'P' || p_partkey where s.label = 'Function'),
m as (select p.src, p.dst, s.uid, row_number() over (partition by p.src, p.dst order by a desc, seq) as n from probe p join span s on s.path = p.path and p.line between a and b)
select p.src, p.dst, p.line, m.uid from probe p left join m on m.src = p.src and m.dst = p.dst and m.n = 1""")
def q_innermost_span(spark: SparkSession, sf: str) -> DataFrame:
    """Each call site's innermost containing function, an interval join on buckets of lines."""
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("P"), "p_partkey").alias("k"), "p_size", F.col("p_partkey").alias("seq"))
    spans = symbols(spark, sf).where("label = 'Function'").join(part, "k").select("path", "uid", F.col("line_number").alias("a"), (F.col("line_number") + F.col("p_size") % 6).alias("b"), "seq")
    found = joins.innermost(_probes(spark, sf), spans, ["path"], "line", "a", "b")
    return found.select("src", "dst", "line", "found.uid")


@query("""with e as (select event_id, user_id, ts from events where event_type = 'error'), v as (select event_id as vid, user_id, ts as vts, event_type as vtype from events where event_type in ('signup', 'view')),
m as (select e.event_id, vid, vtype, row_number() over (partition by e.event_id order by vts desc, vid desc) as n from e join v on v.user_id = e.user_id and vts <= e.ts)
select e.event_id, m.vid as cause_id, m.vtype as cause from e left join m on m.event_id = e.event_id and m.n = 1""")
def q_event_cause(spark: SparkSession, sf: str) -> DataFrame:
    """J5 over a stream table: each error's latest earlier signup or view of the same user."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    causes = events.where("event_type in ('signup', 'view')")
    found = joins.preceding(errors, causes, ["user_id"], "ts", F.struct("ts", "event_id", "event_type"), slices=F.unix_date(F.to_date("ts")))
    return found.select("event_id", F.col("found.event_id").alias("cause_id"), F.col("found.event_type").alias("cause"))


@query(f"with {SYMBOLS_SQL} select http_method, http_path, name, path, line_number from sym where http_method <> ''")
def q_http_handlers(spark: SparkSession, sf: str) -> DataFrame:
    """Handlers of routes."""
    return symbols(spark, sf).where("http_method <> ''").select("http_method", "http_path", "name", "path", "line_number")


@query(f"{GRAPH_SQL} select a.name as caller, a.path as caller_path, b.name as task, b.path as task_path, c.line_number from calls c join sym a on a.k = c.src join sym b on b.k = c.dst where call_kind = 'celery_dispatch'")
def q_task_dispatches(spark: SparkSession, sf: str) -> DataFrame:
    """Dispatched tasks."""
    known = symbols(spark, sf)
    calls = dense_calls(spark, sf).where("call_kind = 'celery_dispatch'").select("src", "dst", "line_number")
    out = calls.join(known.select(F.col("k").alias("src"), F.col("name").alias("caller"), F.col("path").alias("caller_path")), "src")
    return out.join(known.select(F.col("k").alias("dst"), F.col("name").alias("task"), F.col("path").alias("task_path")), "dst").select("caller", "caller_path", "task", "task_path", "line_number")


@query(f"""with {SYMBOLS_SQL}, d as (select path, (list(name order by line_number, name))[1:5] as top from sym group by path), h as (
  select distinct path from sym where http_method <> '')
select path, 'http' as kind, array_to_string(top, ',') as symbols from d where path in (select path from h) order by path limit 50""")
def q_entry_points(spark: SparkSession, sf: str) -> DataFrame:
    """Files of handlers with their first five symbols, fifty at most."""
    known = symbols(spark, sf)
    top = known.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line_number", "name"))).where("n <= 5")
    joined = top.groupBy("path").agg(F.expr("array_join(transform(array_sort(collect_list(struct(n, name))), x -> x.name), ',')").alias("symbols"))
    handlers = known.where("http_method <> ''").select("path").distinct()
    return first_rows(joined.join(handlers, "path", "left_semi").select("path", F.lit("http").alias("kind"), "symbols"), 50, "path")


@query(f"with {SYMBOLS_SQL} select * from (select label, name, path, uid, cast(row_number() over (partition by label order by name, path, line_number, uid) as integer) as n from sym where regexp_matches(lower(name), 'an')) where n <= 25 order by label, n limit 50")
def q_name_search(spark: SparkSession, sf: str) -> DataFrame:
    """Case-blind search in names, twenty-five of a label, fifty in all."""
    hits = symbols(spark, sf).where(scalars.contains_literally(F.col("name"), "an"))
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("name", "path", "line_number", "uid"))).where("n <= 25")
    return first_rows(ranked.select("label", "name", "path", "uid", "n"), 50, "label", "n")


_DRAWN = f"""{GRAPH_SQL}, w as (select dst as k, count(*) as weight from calls group by dst), keep as materialized (
  select uid, k, label, name, path, line_number, coalesce(weight, 0) as weight from sym left join w using (k) order by coalesce(weight, 0) desc, uid limit 6000),
big as materialized (select path, count(*) as weight from sym group by path order by count(*) desc, path limit 1500),
imp as (select distinct a.path as s, b.path as d from calls join sym a on a.k = src join sym b on b.k = dst where a.path <> b.path and md5(a.path || b.path) < '1')"""


def _drawn(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    known = symbols(spark, sf)
    end = lambda k, c: known.select(F.col("k").alias(k), F.col("uid").alias(f"{c}_uid"), F.col("path").alias(f"{c}_path"))
    calls = dense_calls(spark, sf).select("src", "dst").join(end("src", "source"), "src").join(end("dst", "target"), "dst")
    linked = calls.where("source_path <> target_path").select(F.col("source_path").alias("src_path"), F.col("target_path").alias("dst_path")).distinct()
    linked = linked.where(F.md5(F.concat("src_path", "dst_path")) < "1")
    return export.drawn(known, calls.select("source_uid", "target_uid", F.lit("CALLS").alias("relation")), linked)


@query(f"""{_DRAWN} select a.uid as source, b.uid as target, 'CALLS' as relation from calls join keep a on a.k = src join keep b on b.k = dst where a.uid <> b.uid
union all select s, d, 'IMPORTS' from imp where s in (select path from big) and d in (select path from big)
union all select path, uid, 'CONTAINS' from keep where path in (select path from big)""")
def q_web_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Links among the six thousand most called symbols and the fifteen hundred largest files."""
    return _drawn(spark, sf)[1]


@query(f"""{_DRAWN} select uid as id, label as kind, name, path, line_number as line, cast(weight as bigint) as weight from keep
union all select path, 'File', regexp_extract(path, '([^/]+)$', 1), path, 0, weight from big""")
def q_web_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Q18, A3: those symbols by calls, and those files by symbols."""
    return _drawn(spark, sf)[0]


@query("""with o as (select doc_id as p, md5(coalesce(text, '')) as m from documents where doc_id % 17 <> 0), n as (
  select doc_id as p, md5(case when doc_id % 13 = 0 then coalesce(text, '') || '!' else coalesce(text, '') end) as m from documents where doc_id % 19 <> 0)
select coalesce(o.p, n.p) as path, case when o.p is null then 'added' when n.p is null then 'deleted' else 'changed' end as state from o full join n on o.p = n.p
where o.p is null or n.p is null or o.m <> n.m""")
def q_manifest_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Added, changed and deleted files between two snapshots."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    old = manifest.snapshot(docs.where("path % 17 <> 0"))
    new = manifest.snapshot(docs.where("path % 19 <> 0").withColumn("text", F.when(F.col("path") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return manifest.changes(old, new)


@query("""with h as (select page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) as route from pages)
select route, cast(count(*) as bigint) as links, cast(count(distinct page_id) as bigint) as pages from h group by route""")
def q_linked_routes(spark: SparkSession, sf: str) -> DataFrame:
    """F8: routes in markup by pattern, counted."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("route"))
    return pages.groupBy("route").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query("""select cast(ts as date) as day, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by 1, 2""")
def q_daily_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over the events, as the stream computes them."""
    out = manifest.activity(spark.read.parquet(f"{sf}/events.parquet"))
    return out.select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with o as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as b, event_id from events),
g as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from o)
select user_id, min(ts) as start, cast(count(*) as bigint) as n from g group by user_id, s""")
def q_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session windows over the events."""
    return manifest.sessions(spark.read.parquet(f"{sf}/events.parquet")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"with {SYMBOLS_SQL} select path, cast(count(*) as bigint) as symbols from sym group by path")
def q_symbols_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """A5: symbols of every file."""
    return symbols(spark, sf).groupBy("path").agg(F.count("*").alias("symbols"))


@query(f"with {RAW_SQL} select cast(count(*) as bigint) as total, cast(count(*) filter (call_kind = 'local') as bigint) as local, cast(count(*) filter (dst is null) as bigint) as external from raw")
def q_call_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Call sites in all, of local calls, and without a known target."""
    return raw_calls(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("call_kind") == "local").alias("local"), F.count_if(F.col("dst").isNull()).alias("external"))


@query("""with r as (select p_partkey as id, case p_size % 3 when 0 then '.' || p_name || '()' when 1 then upper(substr(p_name, 1, 1)) || substr(p_name, 2) else p_name end as raw, 'L' || p_size as loc from part)
select id, regexp_replace(regexp_replace(raw, '[()]+$', ''), '^\\.+', '') as name, case when raw like '%()' then 'Function' when regexp_matches(raw, '^[A-Z]') then 'Class' else 'Function' end as label, cast(substr(loc, 2) as bigint) as line_number from r""")
def q_raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Displayed labels to names, kinds and lines."""
    name, size = F.col("p_name"), F.col("p_size") % 3
    raw = F.when(size == 0, F.concat(F.lit("."), name, F.lit("()"))).when(size == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))).otherwise(name)
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), raw.alias("raw"), F.concat(F.lit("L"), "p_size").alias("at"))
    return rows.select("id", scalars.symbol_name(F.col("raw")).alias("name"), scalars.inferred_label(F.col("raw")).alias("label"), scalars.line_label(F.col("at")).alias("line_number"))


@query("select doc_id, cast(n + 1 as bigint) as line, length(l) as signs from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(0, len(string_split(text, chr(10))))) as n from documents where text is not null) where length(l) > 200")
def q_line_index(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as numbered lines, those of more than 200 signs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "l")).where(F.length("l") > 200)
    return lines.select("doc_id", (F.col("n") + 1).cast("long").alias("line"), F.length("l").cast("long").alias("signs"))
