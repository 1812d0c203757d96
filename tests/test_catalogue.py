from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom import catalogue

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, db, name):
    same(spark, db, catalogue.QUERIES[name], catalogue.SQL[name], SF)


def test_communities_cover_all_symbols_once(spark):
    from graphloom.model import symbols

    found = catalogue.QUERIES["q_communities"](spark, SF)
    assert found.count() == found.select("uid").distinct().count() == symbols(spark, SF).count()


def test_every_file_has_one_cluster(spark):
    found = catalogue.QUERIES["q_clusters"](spark, SF).collect()
    from graphloom.model import symbols

    assert sum(r["files"] for r in found) == symbols(spark, SF).select("path").distinct().count()
    assert sum(r["is_foundational"] for r in found) <= 1


def _with(tmp_path, **tables):
    """A folder of the driver tables in which ``tables`` stand in for those of their names."""
    for f in Path(SF).glob("*.parquet"):
        if f.stem not in tables:
            (tmp_path / f.name).symlink_to(f)
    for name, rows in tables.items():
        pq.write_table(rows, tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_passages_over_lines_and_to_the_middle_of_a_word(spark, tmp_path):
    texts = ["zero one two three four five six seven", "zero one\ntwo three four five\nsix seven", "a one two three four fivefold", "nothing of it", None]
    items = ["one two three four five six", "one\ntwo three four five\nsix", "ne two three four five", "ro one two three four five s", "two", None]
    documents = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    sf = _with(tmp_path, documents=documents, benchmark=pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": items}))
    same(spark, connect(sf), catalogue.QUERIES["q_search_quality"], catalogue.SQL["q_search_quality"], sf)
    found = {r["qid"]: r["ndcg"] for r in catalogue.QUERIES["q_search_quality"](spark, sf).collect()}
    assert all(found[q] > 0 for q in range(5)) and found[5] == 0


def test_means_are_rounded_as_the_sql_rounds(spark, tmp_path):
    from graphloom.plans.retrieval import _four

    values = [0.50105, 0.12345, 0.38835, 0.00015, 0.70005, 1.0, 0.0, 24.64625]
    pq.write_table(pa.table({"x": values}), tmp_path / "x.parquet")
    want = connect(SF).execute(f"select x, round(x, 4) from '{tmp_path}/x.parquet'").fetchall()
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", _four(F.col("x")).alias("y")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    plain = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.round("x", 4)).collect()
    assert sorted(map(tuple, plain)) != sorted(want)


def test_related_vectors_of_odd_rows_and_copies(spark, tmp_path, monkeypatch):
    import numpy as np

    from graphloom.operators import search

    monkeypatch.setattr(search, "CHUNK", 64)
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(420, 8)).astype(np.float32).tolist()
    rows[1] = rows[50] = rows[300] = [0.0] * 8  # no direction
    rows[2] = rows[100] = rows[301] = None
    rows[150:260] = [rows[150]] * 110  # copies, more than a chunk and the asked ones among them
    rows[260:300] = rng.integers(-2, 3, (40, 8)).astype(np.float32).tolist()  # many equal cosines
    rows[302] = [float("nan")] + [1.0] * 7
    rows[303] = [float("inf")] + [1.0] * 7
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    sf = _with(tmp_path, embeddings=table)
    same(spark, connect(sf), catalogue.QUERIES["q_find_related"], catalogue.SQL["q_find_related"], sf)
