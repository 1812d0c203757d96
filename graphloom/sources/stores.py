"""Graph tables as JSON lines, for other tools, and back: call graphs, topologies, communities, manifests, truths.

One record a line, so that a store of any size is written and read in parallel. A store that is missing reads as None.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The version of stored call graphs, and the schemas of the stores.
VERSION = 2
SCHEMAS = {
    "edges": "caller_file string, caller_symbol string, callee_file string, callee_symbol string, call_kind string, call_site_line bigint, version int",
    "relations": "src string, dst string, kind string, metadata map<string,string>",
    "communities": "community_id bigint, uid string",
    "topology": "path string, indegree bigint, depth int, cluster_id string, is_foundational boolean",
    "manifest": "path string, md5 string",
    "truth": "id string, query string, relevant_files array<string>, relevant_symbols array<string>, query_type string",
}


def save(rows: DataFrame, path: str, kind: str) -> None:
    """Replace the store of a kind; only the columns of its schema are written."""
    want = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
    rows.select(*(c for c in want if c in rows.columns)).write.mode("overwrite").json(f"{path}/{kind}")


def load(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.schema(SCHEMAS[kind]).json(f"{path}/{kind}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def call_graph(edges: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Call edges once for each pair of symbols (the first site), relations once for each source, target and kind (the least metadata)."""
    pair = ["caller_file", "caller_symbol", "callee_file", "callee_symbol"]
    calls = edges.groupBy(*pair).agg(F.min(F.struct("call_site_line", "call_kind")).alias("s"))
    calls = calls.select(*pair, "s.call_kind", "s.call_site_line", F.lit(VERSION).alias("version"))
    return calls, relations.groupBy("src", "dst", "kind").agg(F.from_json(F.min(F.to_json("metadata")), "map<string,string>").alias("metadata"))


def save_index(chunks: DataFrame, path: str) -> None:
    """A search index: the chunks (id, text, ...) and their postings, grouped by term for reading by term."""
    from ..operators.search import postings

    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    postings(chunks).repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """chunks and postings, or None if either is missing or broken."""
    try:
        return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings")
    except AnalysisException:
        return None
