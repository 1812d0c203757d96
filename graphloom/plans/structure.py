"""Topology, components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DENSE_SQL, RAW_SQL, SYMBOLS_SQL, TOPOLOGY_SQL, dense_calls, file_calls, sparse_calls, symbols
from ..operators import community, topology
from ..session import cut
from .lookup import query

_METRICS = """f as (select distinct path from sym), deg as (select f.path, cast(count(distinct fc.sf) as bigint) as indegree from f left join fc on fc.df = f.path group by f.path),
met as materialized (select path, indegree, indegree >= greatest(3, floor((select count(*) from f) * 0.05)) as is_foundational from deg)"""
_ENTRY = "ent as materialized (select distinct path from sym where http_method <> '' union select path from met where indegree = 0 and not is_foundational)"


def _files(spark: SparkSession, sf: str):
    pairs = cut(file_calls(spark, sf))
    known = symbols(spark, sf)
    metrics = cut(topology.foundational(topology.degrees(pairs, known.select("path").distinct())))
    handlers = known.where("http_method <> ''").select("path").distinct()
    return pairs, metrics, cut(topology.entries(metrics, handlers))


@query(f"{TOPOLOGY_SQL}, {_METRICS} select path, indegree, is_foundational from met")
def q_file_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct calling files of every file, and which files are foundational."""
    return _files(spark, sf)[1]


def _depth_parts(limit: int) -> str:
    """Tables d0 to d{limit}, and dep: path, depth."""
    parts = ["d0 as materialized (select path as id from ent)"]
    for d in range(1, limit):
        known = " union all ".join(f"select id from d{k}" for k in range(d))
        parts.append(f"d{d} as materialized (select distinct df as id from fc join d{d - 1} l on l.id = sf where df not in ({known}))")
    union = " union all ".join(f"select id, {d} as depth from d{d}" for d in range(limit))
    return f"{', '.join(parts)}, a as ({union}), dep as materialized (select f.path, cast(coalesce(a.depth, 999) as integer) as depth from f left join a on a.id = f.path)"


def _depth_sql(limit: int) -> str:
    return f"{TOPOLOGY_SQL}, {_METRICS}, {_ENTRY}, {_depth_parts(limit)} select path, depth from dep"


@query(_depth_sql(20))
def q_file_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Hops from the nearest entry file."""
    pairs, metrics, entry = _files(spark, sf)
    return topology.depths(pairs, metrics, entry)


def _label_sql() -> str:
    parts = [
        "seed as materialized (select path, cast(row_number() over (order by path) as integer) as n from ent where path in (select path from met where not is_foundational))",
        "ins as materialized (select sf as src, df as dst, cast(row_number() over (partition by sf order by df) as integer) as rank from fc where df in (select path from met where not is_foundational))",
        "l0 as materialized (select path as id, [n] as key from seed)",
    ]
    for d in range(1, 5):
        known = " union all ".join(f"select id from l{k}" for k in range(d))
        parts.append(f"l{d} as materialized (select dst as id, min(list_append(l.key, r.rank)) as key from l{d - 1} l join ins r on r.src = l.id where dst not in ({known}) group by dst)")
    union = " union all ".join(f"select id, key from l{d}" for d in range(5))
    return f"{TOPOLOGY_SQL}, {_METRICS}, {_ENTRY}, {', '.join(parts)}, lab as materialized (select u.id as path, s.path as seed from ({union}) u join seed s on s.n = u.key[1])"


@query(f"{_label_sql()} select path, seed from lab")
def q_cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's first reaching entry, within four hops, never through foundational files."""
    return topology.labelled(*_files(spark, sf))


def _adopt_sql(rounds: int) -> str:
    parts = ["v as materialized (select sf as path, df as other, 2 as w from fc union all select df, sf, 1 from fc)", "us as materialized (select path from met where not is_foundational)", "k0 as materialized (select path, seed from lab)"]
    for r in range(rounds):
        parts.append(f"w{r} as materialized (select v.path, k.seed, sum(w) as w from v join k{r} k on k.path = v.other where v.path in (select path from us) and v.path not in (select path from k{r}) group by 1, 2)")
        parts.append(f"k{r + 1} as materialized (select path, seed from k{r} union all select path, (list(seed order by w desc, seed))[1] from w{r} group by path)")
    parts.append(f"big as (select seed from k{rounds} group by seed order by count(*) desc, seed limit 1)")
    parts.append(f"fin as materialized (select path, seed from k{rounds} union all select path, (select seed from big) from us where path not in (select path from k{rounds}) and exists (select 1 from big))")
    return ", ".join(parts)


@query(f"{_label_sql()}, {_adopt_sql(8)} select path, seed from fin")
def q_cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with the other files adopted by their neighbours' votes."""
    pairs, metrics, entry = _files(spark, sf)
    return topology.adopted(pairs, metrics, topology.labelled(pairs, metrics, entry))


@query(f"""{_label_sql()}, {_adopt_sql(8)}, {_depth_parts(20)}, rows as (select path, seed from fin union all select path, 'foundational' from met where is_foundational),
sl as (select seed, b, row_number() over (partition by b order by seed) - 1 as n from (select distinct seed, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(seed), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 64), ''), 'cluster') as b from fin))
select rows.seed, cast(count(*) as bigint) as files, cast(coalesce(min(depth) filter (depth < 999 and not is_foundational), 999) as integer) as min_depth, cast(coalesce(max(depth) filter (depth < 999 and not is_foundational), 0) as integer) as max_depth,
round(avg(indegree), 4) as avg_indegree, bool_or(is_foundational) as is_foundational, coalesce(max(case when n = 0 then b else substr(b, 1, 58) || '-' || n end), 'foundational') as cluster_id
from rows join met using (path) join dep using (path) left join sl on sl.seed = rows.seed group by rows.seed""")
def q_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters with their ids, depths, mean in-degree, and the foundational one."""
    pairs, metrics, entry = _files(spark, sf)
    label = topology.adopted(pairs, metrics, topology.labelled(pairs, metrics, entry))
    return topology.clusters(label, metrics, topology.depths(pairs, metrics, entry))


@query(f"""{_label_sql()}, {_adopt_sql(8)}, fe as (select path, seed, row_number() over (partition by seed order by path) as f from fin where path in (select path from ent) qualify f <= 3),
ts as (select seed, f, name, row_number() over (partition by sym.path order by line_number, name) as s from sym join fe on fe.path = sym.path qualify s <= 4),
nm as (select seed, name, min(f * 10 + s) as p from ts group by seed, name)
select seed, array_to_string((list(name order by p))[1:10], ',') as entry_symbols from nm group by seed""")
def q_cluster_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The first symbols of each cluster's first entry files."""
    pairs, metrics, entry = _files(spark, sf)
    label = cut(topology.adopted(pairs, metrics, topology.labelled(pairs, metrics, entry)))
    found = topology.entry_symbols(label, entry, symbols(spark, sf).select("path", "line_number", "name"))
    return found.select("seed", F.array_join("entry_symbols", ",").alias("entry_symbols"))


@query(f"{_label_sql()}, {_adopt_sql(8)} select distinct seed, df as path from fc join fin on fin.path = sf where df in (select path from met where is_foundational)")
def q_shared_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """The foundational files that each cluster calls."""
    pairs, metrics, entry = _files(spark, sf)
    label = topology.adopted(pairs, metrics, topology.labelled(pairs, metrics, entry))
    return topology.shared_dependencies(label, pairs, metrics)


@query(f"""{_label_sql()}, {_adopt_sql(8)}, {RAW_SQL}, {DENSE_SQL} select seed, 'file' as what, path as value from fin union all select seed, 'entry_file', path from fin where path in (select path from ent)
union all select distinct seed, 'side_effect', call_kind || ':' || b.name from calls join sym a on a.k = src join sym b on b.k = dst join fin on fin.path = a.path where call_kind = 'celery_dispatch'""")
def q_cluster_details(spark: SparkSession, sf: str) -> DataFrame:
    """Files, entry files and side effects of each cluster, a row each."""
    pairs, metrics, entry = _files(spark, sf)
    label = cut(topology.adopted(pairs, metrics, topology.labelled(pairs, metrics, entry)))
    at = symbols(spark, sf)
    calls = dense_calls(spark, sf).select("src", "dst", "call_kind").join(at.select(F.col("k").alias("src"), "path"), "src").join(at.select(F.col("k").alias("dst"), F.col("name").alias("callee")), "dst")
    return topology.details(label, entry, calls)


_MEMBERS = "mem as (select distinct l_returnflag || l_linestatus || (l_quantity::int % 5) as cluster, l_suppkey as path from lineitem)"


@query(f"""with {_MEMBERS}, z as (select cluster, count(*) as n from mem group by 1), s as (select x.cluster as a, y.cluster as b, count(*) as k from mem x join mem y on x.path = y.path and x.cluster < y.cluster group by 1, 2)
select a, b, round(k / (p.n + q.n - k), 6) as jaccard from s join z p on p.cluster = a join z q on q.cluster = b where k / (p.n + q.n - k) >= 0.6""")
def q_overlapping_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of clusters whose members overlap by three fifths."""
    item = spark.read.parquet(f"{sf}/lineitem.parquet")
    members = item.select(F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity").cast("int") % 5).cast("string")).alias("cluster"), F.col("l_suppkey").alias("path")).distinct()
    return topology.merged_by_overlap(members).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""{TOPOLOGY_SQL.replace("with ", "with recursive ", 1)}, und as (select distinct least(src, dst) as a, greatest(src, dst) as b from sparse where src <> dst), e as (select a, b from und union all select b, a from und),
r(a, b) as (select distinct a, a from e union select r.a, e.b from r join e on e.a = r.b) select a as k, min(b) as component from r group by a""")
def q_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the undirected call graph, by least reachable key."""
    edges = cut(community.undirected(sparse_calls(spark, sf)))
    return community.components(edges).select(F.col("uid").alias("k"), "component")


@query(None)
def q_communities(spark: SparkSession, sf: str) -> DataFrame:
    """A community for every symbol."""
    known = symbols(spark, sf).select(F.col("k").alias("uid"))
    return community.communities(sparse_calls(spark, sf), known)


@query(f"""{TOPOLOGY_SQL}, und as (select distinct least(src, dst) as a, greatest(src, dst) as b from sparse where src <> dst), c as (select k, substr(md5(k), 1, 1) as community from sym), z as (select community, count(*) as n from c group by 1),
i as (select x.community, count(*) as e from und join c x on x.k = a join c y on y.k = b where x.community = y.community group by 1)
select z.community, cast(n as bigint) as n, round(case when n <= 1 then 1.0 else coalesce(e, 0) / (n * (n - 1) / 2) end, 9) as cohesion from z left join i on i.community = z.community""")
def q_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    """Edges inside over possible edges, of a given partition."""
    part = symbols(spark, sf).select("k", F.substring(F.md5("k"), 1, 1).alias("community"))
    edges = community.undirected(sparse_calls(spark, sf))
    inner = edges.join(part.select(F.col("k").alias("a"), F.col("community").alias("x")), "a").join(part.select(F.col("k").alias("b"), F.col("community").alias("y")), "b").where("x = y")
    out = community.cohesion(inner.select(F.col("x").alias("community"), "a", "b"), part.groupBy("community").agg(F.count("*").alias("n")))
    return out.withColumn("cohesion", F.round("cohesion", 9))


@query(f"""{TOPOLOGY_SQL}, und as (select distinct least(src, dst) as a, greatest(src, dst) as b from sparse where src <> dst), deg as (
  select k as uid, cast(count(u) as bigint) as degree from sym left join (select a as u from und union all select b from und) on u = k group by k)
select uid, degree from deg where degree > (select (list(degree order by degree))[1 + greatest(0, cast(floor(count(*) * 95 / 100.0) as bigint) - 1)] from deg)""")
def q_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols with more neighbours than the one at the 95th percentile."""
    edges = community.undirected(sparse_calls(spark, sf))
    return community.hubs(edges, symbols(spark, sf).select(F.col("k").alias("uid")), 95)


@query(f"with {SYMBOLS_SQL} select substr(md5(k), 1, 1) as community, cast(count(*) as bigint) as n from sym group by 1 order by n desc, community limit 5")
def q_largest_communities(spark: SparkSession, sf: str) -> DataFrame:
    """A10: sizes of the five largest communities of a given partition."""
    part = symbols(spark, sf).groupBy(F.substring(F.md5("k"), 1, 1).alias("community")).agg(F.count("*").alias("n"))
    return part.orderBy(F.desc("n"), "community").limit(5)


@query(f"""with {SYMBOLS_SQL}, c as (select uid, name, path, substr(md5(k), 1, 1) as community from sym), r as (select * from c order by uid limit 1)
select c.uid, c.name, c.path from c join r on r.community = c.community and r.path <> c.path order by c.uid limit 10""")
def q_community_peers(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a symbol's community in other files, the first ten by uid."""
    part = symbols(spark, sf).select("uid", "name", "path", F.substring(F.md5("k"), 1, 1).alias("community"))
    root = part.orderBy("uid").limit(1).select("community", F.col("path").alias("home"))
    return part.join(F.broadcast(root), "community").where("path <> home").orderBy("uid").limit(10).select("uid", "name", "path")
