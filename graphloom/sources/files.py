"""Source trees, indexes and graph tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import CODE, language

# Folders that are never read.
IGNORED = (".git", "__pycache__", "node_modules", ".venv", "venv", "env", "dist", "build", ".mypy_cache", ".pytest_cache", "coverage", ".tox")


def repository(spark: SparkSession, root: str) -> DataFrame:
    """path, content, text of the code files below ``root``: any folder named in ``IGNORED`` is left out.

    Files of other extensions are not listed, and those in ignored folders are left out by their path before any byte
    of them is read. Bytes that are not UTF-8 become replacement signs.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"?*.{{{','.join(CODE)}}}").load(root)
    folders = "|".join(x.replace(".", "[.]") for x in IGNORED)
    rows = raw.where(~F.col("_metadata.file_path").rlike(f"/(?:{folders})/"))
    text = F.expr("make_valid_utf8(cast(content as string))")
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content", text.alias("text"))


def dominant_language(files: DataFrame) -> DataFrame:
    """lang, files: the most frequent one, ties by name."""
    return files.groupBy(language(F.col("path")).alias("lang")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "lang").limit(1)


def packages(files: DataFrame) -> DataFrame:
    """root, kind of the packages of a monorepo: TypeScript ones under the usual folders, Go modules if one is nested."""
    # Folders that hold packages.
    ts = files.where(F.col("path").rlike(r"/(?:packages|apps|services|libs|modules)/[^/]+/(?:.*/)?tsconfig\.json$")).select(F.regexp_replace("path", "/[^/]*$", "").alias("root"), F.lit("typescript").alias("kind"))
    mods = files.where(F.col("path").rlike(r"(?:^|/)go\.mod$")).select(F.regexp_replace("path", "/?go\\.mod$", "").alias("root"))
    shallow = mods.agg(F.min(F.size(F.split("root", "/"))).alias("top"), F.max(F.size(F.split("root", "/"))).alias("deep"))
    nested = mods.crossJoin(F.broadcast(shallow)).where("deep > top").select("root", F.lit("go").alias("kind"))  # one row
    return ts.unionByName(nested).distinct()


# Where a package's source begins, first existing one.
ENTRIES = ("src/index.ts", "src/index.tsx", "index.ts", "index.tsx")


def package_entries(files: DataFrame, roots: DataFrame) -> DataFrame:
    """name, entry: packages of ``roots`` (root) by the name in their package.json (path, text), with the first of
    the usual entry files that exists; packages without one are left out."""
    manifests = files.where(F.col("path").endswith("/package.json")).select(F.regexp_replace("path", "/package[.]json$", "").alias("root"), F.get_json_object("text", "$.name").alias("name"))
    named = manifests.where("name <> ''").join(roots.select("root").distinct(), "root", "left_semi")
    tried = named.select("root", "name", F.posexplode(F.array(*(F.lit(x) for x in ENTRIES))).alias("n", "rel")).withColumn("path", F.concat_ws("/", "root", "rel"))
    return tried.join(files.select("path"), "path", "left_semi").groupBy("name").agg(F.min_by("path", F.struct("n", "path")).alias("entry"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of several packages, the first of each key by seq."""
    w = Window.partitionBy(*keys).orderBy("seq")
    return parts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Tables of nodes by label and of edges by relation, replaced as a whole."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, nodes_schema: str, edges_schema: str) -> tuple[DataFrame, DataFrame]:
    """Both tables; columns that an older writer lacked are null."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return read("nodes", nodes_schema), read("edges", edges_schema)


def stale_columns(found: DataFrame, schema: str) -> list[str]:
    """Columns of a schema that a stored table lacks."""
    want = [c.split()[0] for c in schema.split(", ")]
    return [c for c in want if c not in found.columns]


def without_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a file's nodes and every edge at them."""
    gone = nodes.where(F.col("path") == path).select("uid")
    left = edges.join(gone, F.col("source_uid") == gone["uid"], "left_anti").join(gone, F.col("target_uid") == gone["uid"], "left_anti")
    return nodes.where(F.col("path") != path), left
