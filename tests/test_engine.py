import json

import pytest

from graphloom import __main__ as cli
from graphloom.engine import CodeGraph, NotIndexed

# Invented sources of a small service.
FILES = {
    "app/store.py": "class Base:\n    def save(self):\n        return stamp(self)\n\n\nclass Order(Base):\n    def total(self):\n        return self.save()\n\n\ndef stamp(x):\n    return x\n",
    "app/tasks.py": "from store import Order\n\n\ndef remind(order):\n    return Order().total()\n",
    "app/api.py": "from store import Order\nfrom tasks import remind\n\n\n@app.get('/orders/{id}')\ndef show(id):\n    o = Order()\n    return o.total()\n\n\n@app.post('/orders')\ndef create(body):\n    remind.delay(body)\n    return show(1)\n",
    "web/main.go": 'package main\n\nfunc main() {\n    r.Get("/x", show)\n}\n',
    "node_modules/skip.py": "def skipped():\n    pass\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return base


@pytest.fixture(scope="module")
def graph(spark, root, tmp_path_factory):
    g = CodeGraph(spark, str(tmp_path_factory.mktemp("store")))
    with pytest.raises(NotIndexed):
        g.table("nodes")
    losses = {r["relation"]: r["persisted"] for r in g.index(str(root)).collect()}
    assert losses["CALLS"] >= 5 and losses["IMPORTS"] == 3
    return g


def test_lookups(graph):
    names = {r["name"] for r in graph.table("nodes").collect()}
    assert names == {"Base", "Base.save", "Order", "Order.total", "stamp", "remind", "show", "create", "main"}
    assert [r["name"] for r in graph.resolve_symbol("total").collect()] == ["Order.total"]
    assert [r["name"] for r in graph.resolve_symbol("tam").collect()] == ["stamp"]
    assert graph.resolve_symbol("nothing").isEmpty()
    assert graph.resolve_file("api.py").first()["path"].endswith("/app/api.py")
    assert [r["name"] for r in graph.list_symbols("app/store.py").collect()] == ["Base", "Base.save", "Order", "Order.total", "stamp"]
    assert [(r["label"], r["name"]) for r in graph.name_search("ORDER").collect()] == [("Class", "Order"), ("Function", "Order.total")]
    assert [r["name"] for r in graph.file_candidates("tasks.py").collect()] == ["remind"]
    assert len({r["path"] for r in graph.file_candidates("app/").collect()}) == 1 and graph.file_candidates("none.py").isEmpty()
    assert graph.stale() == []
    assert graph.missing().isEmpty()
    assert {r["path"].rpartition("/")[2]: r["symbols"] for r in graph.tree().collect()} == {"api.py": 2, "store.py": 5, "tasks.py": 1, "main.go": 1}


def test_traversal(graph):
    assert [r["to_name"] for r in graph.trace("show").collect()] == ["Order", "Order.total", "Base.save", "stamp"]  # a constructor's call too
    assert {(r["name"], r["to_name"]) for r in graph.trace("create", depth=1).collect()} == {("create", "remind"), ("create", "show")}
    assert {r["to_name"] for r in graph.who_calls("total").collect()} == {"remind", "show"}
    assert [r["name"] for r in graph.find_path("create", "stamp").collect()] == ["create", "remind", "Order.total", "Base.save", "stamp"]
    assert graph.find_path("stamp", "create").isEmpty() and graph.trace("nothing").isEmpty() and graph.find_path("nothing", "show").isEmpty()
    down = [(r["dst"].rpartition("/")[2], r["kind"], r["transitive"]) for r in graph.dependencies("api.py").collect()]
    assert down[:2] == [("store.py", "IMPORTS", False), ("tasks.py", "IMPORTS", False)]
    assert {r["dst"].rpartition("/")[2] for r in graph.dependencies("store.py", "imported_by").collect()} == {"api.py", "tasks.py"}
    assert [r["path"].rpartition("/")[2] for r in graph.files_in_chain("show").collect()] == ["store.py"]
    with pytest.raises(ValueError):
        graph.trace("show", "sideways")


def test_structure(graph):
    assert [(r["http_method"], r["http_path"], r["name"]) for r in graph.handlers().collect()] == [("GET", "/orders/{id}", "show"), ("POST", "/orders", "create")]
    assert [(r["caller"], r["task"]) for r in graph.task_dispatches().collect()] == [("create", "remind")]
    assert {(r["kind"], r["path"].rpartition("/")[2]) for r in graph.entry_points().collect()} == {("http", "api.py"), ("tasks", "tasks.py"), ("topology", "api.py"), ("topology", "main.go")}
    one = graph.context("create").collect()
    assert len(one) == 1 and one[0]["is_entry"] and one[0]["depth"] == 0
    assert graph.context("store.py").first()["path"].endswith("store.py")
    status = {(r["what"], r["name"]): r["n"] for r in graph.status().collect()}
    assert status["nodes", "Class"] == 2 and status["edges", "INHERITS"] == 1 and status["edges", "IMPORTS"] == 3
    stats = graph.call_stats().first()
    assert stats["total"] == stats["local"] + stats["external"] and stats["external"] == 5
    nodes, links = graph.export(4, 2)
    drawn = [(r["kind"], r["name"], r["weight"]) for r in nodes.orderBy("kind", "name").collect()]
    assert sum(k != "File" for k, _, _ in drawn) == 4 and [x for x in drawn if x[0] == "File"] == [("File", "api.py", 2), ("File", "store.py", 5)]
    ids = {r["id"] for r in nodes.collect()}
    assert all(r["source"] in ids and r["target"] in ids and r["source"] != r["target"] for r in links.collect())
    whole = graph.web_graph()
    assert {x["relation"] for x in whole["links"]} == {"CALLS", "INHERITS", "IMPORTS", "CONTAINS"} and not whole["stats"]["truncated"]
    assert whole["stats"]["nodes"] == 13 and whole["stats"]["nodes_by_kind"]["File"] == 4 and graph.web_graph(4)["stats"]["truncated"]
    detail = graph.node_detail(graph.resolve_symbol("remind").first()["uid"])
    assert [x["name"] for x in detail["callers"]] == ["create"] and "Order.total" in [x["name"] for x in detail["callees"]] and graph.node_detail("none") == {}
    of = {c: [(r["what"], r["value"].rpartition("/")[2]) for r in graph.cluster(c).collect()] for c in {r["cluster_id"] for r in graph.table("clusters").collect()}}
    api = next(rows for rows in of.values() if ("entry_file", "api.py") in rows)
    assert ("side_effect", "celery_dispatch:remind") in api and ("file", "api.py") in api
    uid = graph.resolve_symbol("remind").first()["uid"]
    assert graph.snippet(uid).first()["snippet"] == "def remind(order):\n    return Order().total()"
    assert graph.lines("tasks.py").count() == 6 and graph.lines("/etc/passwd").isEmpty()


def test_search(spark, graph):
    best = graph.search("remind order").first()
    assert best["file"].endswith("tasks.py") and best["symbol"] == "remind" and best["tier"] == "strong"
    assert all(not r["file"].endswith("tasks.py") for r in graph.related("tasks.py", 4).collect())
    truth = spark.createDataFrame([("q1", "remind order", ["app/tasks.py"], ["def remind"], "semantic"), ("q2", "zzz", ["app/api.py"], [], "symbol")], "id string, query string, relevant_files array<string>, relevant_symbols array<string>, query_type string")
    got = {r["qid"]: r for r in graph.evaluate(truth).collect()}
    assert got["q1"]["ndcg"] == got["q1"]["mrr"] == got["q1"]["symbol_mrr"] == 1.0 and got["q2"]["ndcg"] == 0.0


def test_reindex_and_command_line(spark, root, tmp_path, capsys):
    store = str(tmp_path / "s")
    graph = CodeGraph(spark, store)
    assert graph.reindex(str(root))["added"] == 4
    assert graph.reindex(str(root))["state"] == "up_to_date"
    extra = root / "app/late.py"
    extra.write_text("def late():\n    pass\n")
    try:
        assert graph.reindex(str(root)) == {"state": "updated", "added": 1, "changed": 0, "deleted": 0}
        assert not graph.resolve_symbol("late").isEmpty()
    finally:
        extra.unlink()
    capsys.readouterr()
    cli.main([store, "list-symbols", "late.py"])
    assert json.loads(capsys.readouterr().out)["name"] == "late"


def test_empty_repository(spark, tmp_path):
    graph = CodeGraph(spark, str(tmp_path / "s"))
    graph.write(spark.createDataFrame([], "path string, text string"))
    assert graph.status().isEmpty() and graph.trace("x").isEmpty() and graph.search("x").isEmpty() and graph.context("x").isEmpty()


def test_compiled_index_comes_first(spark, tmp_path):
    from .test_sources import _field, _occurrence

    p = "scip-x python pkg 1.0 "
    a = _field(1, b"a.py") + _occurrence([0, 4, 7], p + "a/run().", 1, [0, 0, 3, 0]) + _occurrence([2, 4, 8], p + "b/help().") + _occurrence([1, 14, 18], p + "b/help().")
    b = _field(1, b"b.py") + _occurrence([0, 4, 8], p + "b/help().", 1, [0, 0, 1, 0])
    index = spark.createDataFrame([(_field(2, a) + _field(2, b),)], "content binary")
    files = spark.createDataFrame([("a.py", "def run():\n    from b import help\n    help(1)"), ("b.py", "def help():\n    pass")], "path string, text string")
    graph = CodeGraph(spark, str(tmp_path / "s"))
    graph.write(files, index)
    assert [(r["to_name"], r["call_kind"], r["confidence"]) for r in graph.trace("run").collect()] == [("help", "local", "EXTRACTED")]
    assert [(r["src"], r["dst"], r["kind"]) for r in graph.dependencies("a.py", depth=1).collect()] == [("a.py", "b.py", "IMPORTS")]
    graph.write(files, index.where("false"))
    assert [(r["to_name"], r["call_kind"]) for r in graph.trace("run").collect()] == [("help", "resolved")]


def test_levels_have_no_limit(spark):
    from graphloom.operators.expand import levels

    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(66)], "src string, dst string").coalesce(1)
    got = levels(edges, spark.createDataFrame([("f0",)], "id string").coalesce(1))
    assert {r["id"]: r["depth"] for r in got.collect()} == {f"f{i}": i for i in range(67)}


def test_reports(graph, monkeypatch):
    from graphloom import engine

    one = graph.trace_report("show")
    assert one["found"] and not one["truncated"] and one["root_file"].endswith("/app/api.py") and len(one["chain"]) == 4 and "alternatives" not in one
    none = graph.trace_report("tasks.py")
    assert not none["found"] and [c["name"] for c in none["candidates"]] == ["remind"]
    assert graph.trace_report("nothing") == {"root": "nothing", "found": False, "chain": []}
    several = graph.trace_report("Order", file="store.py")
    assert several["root"] == "Order"
    deps = graph.dependencies_report("api.py", depth=9)
    assert deps["dep_count"] == len(deps["deps"]) >= 2 and deps["truncated"] is False and deps["depth"] == 3
    monkeypatch.setattr(engine, "ENTRIES", 1)
    assert graph.entry_points().collect()[-1]["kind"] == "truncation_notice"


def test_names_with_several_symbols(spark, tmp_path):
    g = CodeGraph(spark, str(tmp_path / "store"))
    g.write(spark.createDataFrame([("/r/a.py", "def go():\n    return 1\n"), ("/r/b.py", "def go():\n    return 2\n")], "path string, text string"))
    assert [x["file"] for x in g.trace_report("go")["alternatives"]] == ["/r/b.py"]
    assert g.trace_report("go", file="b.py")["root_file"] == "/r/b.py"


def test_stored_postings_search_alike(graph):
    from graphloom.operators import search

    asked = graph.spark.createDataFrame([(1, "save the order total"), (2, "stamp x return"), (3, "nothing of it"), (4, "")], "qid int, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "rank", "id", "score").collect())
    want = rows(search.bm25(graph.table("chunks").select("id", "text"), asked, 5))
    assert want and rows(search.bm25_of_postings(graph.table("postings"), graph.table("corpus"), asked, 5)) == want


def test_files_go_and_come(spark, root, tmp_path):
    graph = CodeGraph(spark, str(tmp_path / "s"))
    graph.index(str(root))
    store = graph.resolve_file("app/store.py").first()["path"]
    assert graph.remove_file(store) == 5 and graph.remove_file(store) == 0
    left = graph.table("nodes")
    assert left.where(left.path == store).isEmpty() and graph.table("imports").where("dst_path like '%store.py'").isEmpty()
    assert graph.clear() == left.count() > 0
    assert graph.table("nodes").isEmpty() and graph.resolve_symbol("show").isEmpty()
    assert graph.prune() == 2 and graph.table("nodes").isEmpty()
