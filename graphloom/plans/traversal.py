"""Traversal queries: trace, callers, paths, dependencies, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GRAPH_SQL, dense_calls, symbols
from ..operators.expand import capped, shortest_path, traverse
from ..operators.order import placed
from ..session import cut
from .build import dependencies, file_links
from .lookup import query

_ROOT = "(select k from sym where label = 'Function' order by cast(substr(k, 2) as bigint) limit 1)"
_GOAL = "(select k from sym where label = 'Function' order by cast(substr(k, 2) as bigint) desc limit 1)"


def _root(spark: SparkSession, sf: str, last: bool = False) -> DataFrame:
    number = F.substring("k", 2, 20).cast("bigint")
    return symbols(spark, sf).where("label = 'Function'").orderBy(number.desc() if last else number).limit(1).select(F.col("k").alias("id"))


def _edges(spark: SparkSession, sf: str, callers: bool = False, cap: int | None = 30) -> DataFrame:
    """src, dst, rank and attributes, in the order of the neighbours' names."""
    calls = dense_calls(spark, sf)
    if callers:
        calls = calls.withColumnsRenamed({"src": "_d", "dst": "src"}).withColumnRenamed("_d", "dst")
    named = calls.join(symbols(spark, sf).select(F.col("k").alias("dst"), "name", "uid"), "dst")
    return cut(capped(named, ["name", "uid"], cap).select("src", "dst", "rank", "line_number", "call_kind", "confidence"))


def _levels_sql(edges: str, depth: int, start: str = _ROOT) -> str:
    parts = [f"l0 as materialized (select {start} as id, cast([] as integer[]) as key)"]
    for d in range(1, depth + 1):
        parts.append(f"e{d} as materialized (select r.*, list_append(l.key, r.rank) as key, {d} as depth from l{d - 1} l join {edges} r on r.src = l.id)")
        known = " union all ".join(f"select id from l{k}" for k in range(d))
        parts.append(f"l{d} as materialized (select dst as id, min(key) as key from e{d} where dst not in ({known}) group by dst)")
    return ", ".join(parts)


def _ranked_sql(callers: bool, cap: int | None) -> str:
    s, d = ("dst", "src") if callers else ("src", "dst")
    limit = f" qualify rank <= {cap}" if cap else ""
    return f"ranked as materialized (select c.{s} as src, c.{d} as dst, c.line_number, c.call_kind, c.confidence, cast(row_number() over (partition by c.{s} order by s.name, s.uid) as integer) as rank from calls c join sym s on s.k = c.{d}{limit})"


def _trace_sql(callers: bool, depth: int, cap: int | None, top: int | None) -> str:
    union = " union all ".join(f"select src, dst, line_number, call_kind, confidence, key, depth from e{d}" for d in range(1, depth + 1))
    limit = f" where position <= {top}" if top else ""
    return f"""{GRAPH_SQL}, {_ranked_sql(callers, cap)}, {_levels_sql("ranked", depth)}
select * from (select cast(row_number() over (order by depth, key) as integer) as position, depth, src as from_k, dst as to_k, line_number, call_kind, confidence from ({union})){limit}"""


def _flat(found: DataFrame, top: int | None) -> DataFrame:
    if top is None:
        ordered = placed(found, ["depth", "key"]).withColumn("position", F.col("position").cast("int"))
    else:
        ordered = found.orderBy("depth", "key").limit(top).withColumn("position", F.row_number().over(Window.orderBy("depth", "key")))
    return ordered.select("position", "depth", F.col("src").alias("from_k"), F.col("dst").alias("to_k"), "line_number", "call_kind", "confidence")


@query(_trace_sql(False, 3, 30, 100))
def q_trace_callees(spark: SparkSession, sf: str) -> DataFrame:
    """G1, Q2: the first hundred edges of a breadth-first search over callees."""
    return _flat(traverse(_edges(spark, sf), _root(spark, sf), 3), 100)


@query(_trace_sql(True, 3, 30, 100))
def q_trace_callers(spark: SparkSession, sf: str) -> DataFrame:
    """G1, Q2: the same over callers; from is the callee."""
    return _flat(traverse(_edges(spark, sf, callers=True), _root(spark, sf), 3), 100)


@query(_trace_sql(True, 2, None, None))
def q_who_calls(spark: SparkSession, sf: str) -> DataFrame:
    """All callers upwards, without caps."""
    return _flat(traverse(_edges(spark, sf, callers=True, cap=None), _root(spark, sf), 2), None)


def _path_sql(hops: int) -> str:
    parts = [f"l0 as materialized (select {_ROOT} as id, [{_ROOT}] as path, cast([] as integer[]) as key)"]
    for d in range(1, hops + 1):
        known = " union all ".join(f"select id from l{k}" for k in range(d))
        parts.append(f"l{d} as materialized (select dst as id, arg_min(list_append(l.path, r.dst), list_append(l.key, r.rank)) as path, min(list_append(l.key, r.rank)) as key from l{d - 1} l join ranked r on r.src = l.id where dst not in ({known}) group by dst)")
    found = " union all ".join(f"select path from l{d} where id = {_GOAL}" for d in range(1, hops + 1))
    return f"{GRAPH_SQL}, {_ranked_sql(False, 30)}, {', '.join(parts)}, f as (select path from ({found}) order by len(path) limit 1) select cast(unnest(range(0, len(path))) as integer) as hop, unnest(path) as id from f"


@query(_path_sql(15))
def q_find_path(spark: SparkSession, sf: str) -> DataFrame:
    """The first shortest path between two functions."""
    start, goal = _root(spark, sf).first(), _root(spark, sf, last=True).first()
    return shortest_path(_edges(spark, sf), start[0] if start else "", goal[0] if goal else "", 15)


_FILES = """fp as materialized (select distinct a.path as s, b.path as d from calls join sym a on a.k = src join sym b on b.k = dst where a.path <> b.path),
typed as materialized (
  select s as src, d as dst, 'IMPORTS' as kind, cast(row_number() over (partition by s order by d) as integer) as rank from fp where md5(s || d) < '1' qualify rank <= 50
  union all select s, d, 'CALLS', cast(50 + row_number() over (partition by s order by d) as integer) as rank from fp qualify rank <= 80)"""


def _deps_sql(depth: int) -> str:
    start = f"(select path from sym where k = {_ROOT})"
    parts = [f"l0 as materialized (select {start} as id, cast([] as integer[]) as key)"]
    for d in range(1, depth + 1):
        known = " union all ".join(f"select id from l{k}" for k in range(d))
        parts.append(f"h{d} as materialized (select r.*, list_append(l.key, r.rank) as key, {d} as depth from l{d - 1} l join typed r on r.src = l.id)")
        parts.append(f"l{d} as materialized (select dst as id, min(key) as key from h{d} where dst not in ({known}) group by dst)")
        parts.append(f"e{d} as (select h.* from h{d} h left join l{d} l on l.id = h.dst and l.key = h.key where kind = 'IMPORTS' or l.id is not null)")
    union = " union all ".join(f"select src, dst, kind, key, depth from e{d}" for d in range(1, depth + 1))
    return f"{GRAPH_SQL}, {_FILES}, {', '.join(parts)} select * from (select cast(row_number() over (order by depth, key) as integer) as position, src, dst, kind, depth > 1 as transitive from ({union})) where position <= 100"


@query(_deps_sql(2))
def q_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Files that a file imports or calls, imports first; a called file counts where it is first found."""
    at = symbols(spark, sf).select("k", "path")
    pairs = dense_calls(spark, sf).join(at.select(F.col("k").alias("src"), F.col("path").alias("s")), "src").join(at.select(F.col("k").alias("dst"), F.col("path").alias("d")), "dst")
    pairs = cut(pairs.where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
    links = file_links(pairs.where(F.md5(F.concat("src", "dst")) < "1"), pairs)
    start = at.join(_root(spark, sf).withColumnRenamed("id", "k"), "k").select(F.col("path").alias("id"))
    return dependencies(start, traverse(cut(links), start, 2))


_LOCAL = "ranked as materialized (select src, dst, cast(row_number() over (partition by src order by l_orderkey, line_number, dst) as integer) as rank from (select src, dst, min(l_orderkey) as l_orderkey, min(line_number) as line_number from raw where call_kind = 'local' and dst is not null and src <> dst group by src, dst))"


@query(f"""{GRAPH_SQL}, {_LOCAL}, {_levels_sql("ranked", 4)}, u as ({" union all ".join(f"select dst, key, depth from e{d}" for d in range(1, 5))})
select path, cast(min(p) as integer) as position from (select sym.path, row_number() over (order by depth, key) as p from u join sym on k = dst) group by path""")
def q_files_in_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Files of an execution chain over local calls, in order of first use."""
    from ..model import raw_calls

    calls = raw_calls(spark, sf).where("call_kind = 'local' and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("l_orderkey").alias("o"), F.min("line_number").alias("line"))
    edges = cut(capped(calls, ["o", "line", "dst"], None).select("src", "dst", "rank"))
    found = traverse(edges, _root(spark, sf), 4).join(symbols(spark, sf).select(F.col("k").alias("dst"), "path"), "dst")
    return placed(found, ["depth", "key"]).groupBy("path").agg(F.min("position").cast("int").alias("position"))
