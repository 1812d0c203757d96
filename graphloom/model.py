"""The graph's schema, identities, and projections of the driver tables onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The schema's domains.
LABELS = ("Repository", "File", "Directory", "Module", "Function", "Class", "Interface", "Struct", "Enum", "Variable")
RELATIONS = ("CALLS", "IMPORTS", "INHERITS", "CONTAINS", "IMPLEMENTS", "DEFINED_IN")
SYMBOL_LABELS = ("Function", "Class", "Interface", "Struct", "Enum", "Variable")
ENDPOINTS = {
    "CALLS": (("Function", "Function"), ("Function", "Class"), ("Class", "Function")),
    "INHERITS": (("Class", "Class"), ("Class", "Interface"), ("Interface", "Interface"), ("Struct", "Struct")),
    "CONTAINS": (("Class", "Function"),),
    "IMPLEMENTS": (("Class", "Interface"), ("Struct", "Interface")),
}
NODES = (
    "uid string, label string, name string, path string, line_number bigint, end_line bigint, lang string, source string, docstring string,"
    " is_dependency boolean, confidence string, community_id string, cluster_id string, http_method string, http_path string, seq bigint"
)
EDGES = "source_uid string, target_uid string, relation string, confidence string, line_number bigint, call_kind string, alias string, src_path string, dst_path string, seq bigint"


def uid(name: Column, path: Column, line: Column) -> Column:
    return F.md5(F.concat_ws("::", name, path, line.cast("string")))


def with_defaults(nodes: DataFrame) -> DataFrame:
    """Absent optional columns of nodes filled as they are when written."""
    defaults = {"label": "Function", "confidence": "EXTRACTED", "lang": "unknown", "source": "", "docstring": "", "http_method": "", "http_path": "", "community_id": "", "cluster_id": ""}
    have = set(nodes.columns)
    out = {c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()}
    out["is_dependency"] = F.coalesce(F.col("is_dependency"), F.lit(False)) if "is_dependency" in have else F.lit(False)
    out["end_line"] = F.coalesce(F.col("end_line"), F.col("line_number")) if "end_line" in have else F.col("line_number")
    return nodes.withColumns(out)


def last_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last in order: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, k, label, name, path, line_number, http_method, http_path: parts and suppliers as symbols."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    size, key = F.col("p_size") % 10, F.col("p_partkey")
    label = F.when(size == 0, "Interface").when(size == 1, "Enum").otherwise("Function")
    handler = (label == "Function") & (key % 7 == 0)
    p = part.select(
        F.concat(F.lit("P"), key).alias("k"),
        label.alias("label"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("/repo/app/m"), F.expr("p_partkey div 10"), F.lit(".py")).alias("path"),
        (key + 1).cast("long").alias("line_number"),
        F.when(handler & (key % 2 == 0), "GET").when(handler, "POST").otherwise("").alias("http_method"),
        F.when(handler, F.concat(F.lit("/api/"), key)).otherwise("").alias("http_path"),
    )
    s = supplier.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("k"),
        F.lit("Class").alias("label"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("/repo/lib/n"), F.col("s_nationkey"), F.lit(".py")).alias("path"),
        F.col("s_suppkey").cast("long").alias("line_number"),
        F.lit("").alias("http_method"),
        F.lit("").alias("http_path"),
    )
    both = p.unionByName(s)
    return both.select(uid(F.col("name"), F.col("path"), F.col("line_number")).alias("uid"), *both.columns)


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst (keys), line_number, call_kind, confidence and the columns of the order of writing: consecutive items
    of an order, one row a call site; dst is null at an order's end."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *ORDER)
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    kind = F.when(F.col("l_returnflag") == "A", "celery_dispatch").when(F.col("l_returnflag") == "R", "resolved").otherwise("local")
    return item.select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("src"),
        F.concat(F.lit("P"), following).alias("dst"),
        F.col("l_linenumber").cast("long").alias("line_number"),
        kind.alias("call_kind"),
        F.when(F.col("l_linestatus") == "F", "EXTRACTED").otherwise("INFERRED").alias("confidence"),
        "l_orderkey",
        *ORDER,
    )


def dense_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, line_number, call_kind, confidence: what upserts leave of all calls between functions."""
    known = symbols(spark, sf_dir).where("label = 'Function'").select("k")
    calls = raw_calls(spark, sf_dir).where("dst is not null and src <> dst")
    calls = calls.join(known.select(F.col("k").alias("src")), "src", "left_semi").join(known.select(F.col("k").alias("dst")), "dst", "left_semi")
    kept = last_by(calls, ["src", "dst"], [F.col(c) for c in ("l_orderkey", *ORDER)])
    return kept.select("src", "dst", "line_number", "call_kind", "confidence")


def sparse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct calls for topology and communities."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *ORDER)
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    pairs = item.withColumn("to", following)
    a = pairs.where("l_quantity >= 50 and l_returnflag = 'R' and to is not null and to <> l_partkey")
    b = item.where("l_quantity >= 49 and l_returnflag = 'A'")
    return (
        a.select(F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.concat(F.lit("P"), F.col("to")).alias("dst"))
        .unionByName(b.select(F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("dst")))
        .distinct()
    )


def file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sf, df: distinct cross-file pairs of the sparse calls."""
    at = symbols(spark, sf_dir).select("k", "path")
    calls = sparse_calls(spark, sf_dir)
    out = calls.join(at.select(F.col("k").alias("src"), F.col("path").alias("sf")), "src").join(at.select(F.col("k").alias("dst"), F.col("path").alias("df")), "dst")
    return out.where("sf <> df").select("sf", "df").distinct()


# The same projections in DuckDB SQL.
SYMBOLS_SQL = """sym as (
  select md5(name || '::' || path || '::' || cast(line_number as varchar)) as uid, * from (
    select 'P' || p_partkey as k, case p_size % 10 when 0 then 'Interface' when 1 then 'Enum' else 'Function' end as label, p_name as name,
      '/repo/app/m' || (p_partkey // 10) || '.py' as path, cast(p_partkey + 1 as bigint) as line_number,
      case when p_size % 10 > 1 and p_partkey % 7 = 0 then case when p_partkey % 2 = 0 then 'GET' else 'POST' end else '' end as http_method,
      case when p_size % 10 > 1 and p_partkey % 7 = 0 then '/api/' || p_partkey else '' end as http_path from part
    union all
    select 'S' || s_suppkey, 'Class', s_name, '/repo/lib/n' || s_nationkey || '.py', cast(s_suppkey as bigint), '', '' from supplier))"""
_ORDER = ", ".join(ORDER)
_DESC = ", ".join(f"{c} desc" for c in ("l_orderkey", *ORDER))
RAW_SQL = f"""raw as (
  select 'P' || l_partkey as src, 'P' || lead(l_partkey) over (partition by l_orderkey order by {_ORDER}) as dst, cast(l_linenumber as bigint) as line_number,
    case l_returnflag when 'A' then 'celery_dispatch' when 'R' then 'resolved' else 'local' end as call_kind,
    case l_linestatus when 'F' then 'EXTRACTED' else 'INFERRED' end as confidence, l_orderkey, {_ORDER} from lineitem)"""
DENSE_SQL = f"""calls as (
  select src, dst, line_number, call_kind, confidence from (
    select raw.*, row_number() over (partition by src, dst order by {_DESC}) as n from raw
    join sym a on a.k = src and a.label = 'Function' join sym b on b.k = dst and b.label = 'Function' where src <> dst) where n = 1)"""
SPARSE_SQL = f"""sparse as (
  select 'P' || l_partkey as src, 'P' || t as dst from (select *, lead(l_partkey) over (partition by l_orderkey order by {_ORDER}) as t from lineitem)
  where l_quantity >= 50 and l_returnflag = 'R' and t is not null and t <> l_partkey
  union select 'P' || l_partkey, 'S' || l_suppkey from lineitem where l_quantity >= 49 and l_returnflag = 'A'),
fc as (
  select distinct a.path as sf, b.path as df from sparse join sym a on a.k = src join sym b on b.k = dst where a.path <> b.path)"""
GRAPH_SQL = f"with {SYMBOLS_SQL}, {RAW_SQL}, {DENSE_SQL}"
TOPOLOGY_SQL = f"with {SYMBOLS_SQL}, {SPARSE_SQL}"
