import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import routes, scalars
from graphloom.operators import evaluation, joins, writing
from graphloom.sources import files, python_source, scip

MODELS = """class Base:
    def save(self):
        return log(self)

class User(Base):
    def name(self):
        return self.save()

    def twice(self):
        return super().save()

def log(x):
    return x  # audit(x)
"""
APP = """from models import User, log as note
import models

class Service:
    def __init__(self):
        self.user = User()

    def run(self):
        return self.user.name()

def main():
    u = User()
    u.twice()
    note("log(1)")
    models.log(2)
    User().name()

def unsure(flag):
    x = User()
    x = Service()
    x.run()
"""


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("/r/models.py", MODELS), ("/r/app.py", APP), ("/r/bad.py", "def ("), ("/r/x.sql", "select 1")], "path string, text string")


def edges(spark, sources):
    return {(r["caller"], r["callee"]) for r in python_source.calls(python_source.facts(sources)).collect()}


def test_calls_are_resolved(spark, sources):
    found = edges(spark, sources)
    assert {("User.name", "Base.save"), ("User.twice", "Base.save"), ("Base.save", "log"), ("Service.run", "User.name"), ("main", "User.twice"), ("main", "log"), ("main", "User.name")} <= found
    assert ("unsure", "Service.run") not in found
    assert not any(callee == "audit" for _, callee in found)


def test_graph_has_containment_and_inheritance(spark, sources):
    nodes, judged, _ = python_source.graph(sources)
    assert nodes.where("label = 'Class'").count() == 3
    got = {(r["relation"], r["n"]) for r in judged.where("drop_reason is null").groupBy("relation").agg(F.count("*").alias("n")).collect()}
    assert ("INHERITS", 1) in got and ("CONTAINS", 5) in got
    assert [r["suffix"] for r in python_source.unseen_suffixes(sources, nodes).collect()] == [".sql"]
    assert python_source.imports(python_source.facts(sources)).count() == 3


ROUTES = '''@app.get("/items/{item_id}")
@cached
async def get_item(item_id):
    pass

# @app.get("/off")
@bp.route("/users", methods=["POST"])

def user_route():
    task.delay(1)
    # task.delay(2)

@app.post("/lost")
x = 1
def commented_handler():
    pass
'''


def test_routes_and_dispatches(spark):
    df = spark.createDataFrame(
        [
            ("/r/api.py", ROUTES),
            ("/r/f.py", 'app.add_route("/refund", RefundResource(db))\napp.add_route(base + "/x", Other())'),
            ("/r/main.go", 'r.Get("/users/{id}", h.getUser)\n// r.Get("/off", off)\nhttp.HandleFunc("/health", healthz)\nr.Method(http.MethodPost, "/items", createItem)'),
            ("/r/s.ts", "app.get('/a', auth, listAll)\nserver.post(`/b`, make)"),
        ],
        "path string, text string",
    )
    assert {(r["handler"], r["method"], r["route"]) for r in routes.decorated(df).collect()} == {("get_item", "GET", "/items/{item_id}"), ("user_route", "POST", "/users")}
    classes = routes.falcon(df)
    assert {(r["class"], r["route"]) for r in classes.collect()} == {("RefundResource", "/refund"), ("Other", "{base}/x")}
    functions = spark.createDataFrame([("/r/f.py", "RefundResource.on_post"), ("/r/f.py", "RefundResource.help")], "path string, name string")
    assert [(r["method"], r["route"]) for r in routes.falcon_methods(functions, classes).collect()] == [("POST", "/refund")]
    assert {(r["handler"], r["method"]) for r in routes.go(df).collect()} == {("getUser", "GET"), ("healthz", "ANY"), ("createItem", "POST")}
    assert {(r["handler"], r["method"]) for r in routes.scripted(df).collect()} == {("listAll", "GET"), ("make", "POST")}
    assert [(r["line"], r["target"]) for r in routes.dispatches(df).collect()] == [(10, "task")]


def _field(n, value):
    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    return varint(n << 3 | 2) + varint(len(value)) + value


def _occurrence(rng, symbol, roles=0, around=None):
    return _field(2, _field(1, bytes(rng)) + _field(2, symbol.encode()) + (_field(3, roles) if roles else b"") + (_field(7, bytes(around)) if around else b""))


def test_index(spark):
    p = "scip-x python pkg 1.0 "
    a = _field(1, b"a.py") + _occurrence([0, 4, 7], p + "a/run().", 1, [0, 0, 3, 0]) + _occurrence([2, 4, 8], p + "b/help().") + _occurrence([1, 14, 18], p + "b/help().") + _occurrence([0, 0, 1], "local 3", 1)
    b = _field(1, b"b.py") + _occurrence([0, 4, 8], p + "b/help().", 1, [0, 0, 1, 0]) + _occurrence([3, 6, 9], p + "b/Dog#", 1) + _occurrence([5, 6, 9], p + "b/Pet#", 1)
    info = _field(3, _field(1, (p + "b/Dog#").encode()) + _field(3, b"```python\nclass Dog\n```") + _field(4, _field(1, (p + "b/Pet#").encode()) + _field(3, 1)))
    info += _field(3, _field(1, (p + "b/Pet#").encode()) + _field(3, b"```ts\ninterface Pet\n```"))
    raw = spark.createDataFrame([(_field(2, a) + _field(2, b + info),), (b"\xff\xff",)], "content binary")
    found, symbols = scip.occurrences(raw), scip.symbols(raw)
    nodes = scip.nodes(found, symbols)
    assert {(r["name"], r["label"], r["line_number"]) for r in nodes.collect()} == {("run", "Function", 1), ("help", "Function", 1), ("Dog", "Class", 4), ("Pet", "Interface", 6)}
    lines = spark.createDataFrame([("a.py", 1, "def run():"), ("a.py", 2, "from b import help"), ("a.py", 3, "    help(1)"), ("b.py", 1, "def help():")], "path string, line long, text string")
    assert scip.calls(found, nodes, lines).count() == 1
    assert scip.inherits(nodes, symbols).count() == 1
    # a star import: the reference is to the module, the call to its function of that name
    star = _field(1, b"c.py") + _occurrence([0, 4, 6], p + "c/go().", 1, [0, 0, 2, 0]) + _occurrence([1, 4, 8], p + "b/") + _occurrence([2, 4, 8], p + "b/")
    home = _field(1, b"b.py") + _occurrence([0, 0, 0], p + "b/", 1) + _occurrence([0, 4, 8], p + "b/help().", 1, [0, 0, 1, 0])
    loose = spark.createDataFrame([(_field(2, star) + _field(2, home),)], "content binary")
    met = scip.occurrences(loose)
    text = spark.createDataFrame([("c.py", 2, "    help (1)"), ("c.py", 3, "#   help(1)")], "path string, line long, text string")
    assert [r["line_number"] for r in scip.calls(met, scip.nodes(met, scip.symbols(loose)), text).collect()] == [2]
    assert [(r["src_path"], r["dst_path"], r["line_number"]) for r in scip.imports(found, lines).collect()] == [("a.py", "b.py", 2)]


def test_repository_scan(spark, tmp_path):
    for p in ("src/a.py", "node_modules/b.py", "src/c.txt", "src/d.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = files.repository(spark, str(tmp_path))
    assert sorted(r["path"].rpartition("/")[2] for r in found.collect()) == ["a.py", "d.go"]
    assert files.dominant_language(found).first()["lang"] == "go"


def test_scalars(spark):
    df = spark.createDataFrame([("a\nb\nc", ".foo()", "/x/../y/./b.test.py", "L12")], "t string, raw string, path string, l string")
    row = df.select(
        scalars.line_of(F.col("t"), F.lit(4)).alias("line"), scalars.symbol_name(F.col("raw")).alias("name"), scalars.inferred_label(F.col("raw")).alias("label"),
        scalars.canonical(F.col("path")).alias("path"), scalars.suffix(F.col("path")).alias("suffix"), scalars.stem(F.col("path")).alias("stem"), scalars.line_label(F.col("l")).alias("n"), scalars.truncated(F.col("t"), 3, 2).alias("cut"),
    ).first()
    assert tuple(row) == (3, "foo", "Function", "/y/b.test.py", "py", "b.test", 12, "a\nb")


def test_drop_reasons_of_imports(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "a"), ("", "b"), ("a", ""), ("a", "z")], "src_path string, dst_path string")
    known = spark.createDataFrame([("a",), ("b",)], "path string")
    got = sorted(str(r["drop_reason"]) for r in writing.import_reasons(rows, known).collect())
    assert got == ["None", "dst-missing-external", "self-import", "src-missing", "unresolved-external"]


def test_preceding_strict_and_not(spark):
    facts = spark.createDataFrame([("f", 1, "a"), ("f", 5, "b")], "p string, line int, name string")
    probes = spark.createDataFrame([("f", 5), ("f", 0), ("g", 9)], "p string, line int")
    at = lambda strict: {(r["p"], r["line"]): r["found"] and r["found"]["name"] for r in joins.preceding(probes, facts, ["p"], "line", F.struct("name"), strict).collect()}
    assert at(False) == {("f", 5): "b", ("f", 0): None, ("g", 9): None}
    assert at(True)[("f", 5)] == "a"


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "q", 1)], "qid int, id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (2, "z")], "qid int, id string")
    asked = spark.createDataFrame([(1,), (2,)], "qid int")
    got = {r["qid"]: (r["mrr"], r["precision"]) for r in evaluation.metrics(ranked, relevant, asked, 3).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0)}
    snippets = spark.createDataFrame([(1, "def b()", 1), (1, "def a()", 2)], "qid int, snippet string, rank int")
    wanted = spark.createDataFrame([(1, ["a"])], "qid int, symbols array<string>")
    assert evaluation.symbol_mrr(snippets, wanted).first()["symbol_mrr"] == 0.5


def test_raw_graph(spark):
    from graphloom.sources import raw_graph

    raw_nodes = spark.createDataFrame(
        [("f1", "models.py", None, "a/models.py", None), ("f2", "app.py", "code", "a/app.py", "L1"), ("c", "User", "code", "a/models.py", "L3"), ("m", ".save()", "code", "a/models.py", "L4"), ("g", "go()", "code", "a/app.py", "L2"), ("p", "Idea", "paper", "x", "L1"), ("e", "()", "code", "a/app.py", "L9")],
        "id string, label string, file_type string, source_file string, source_location string",
    )
    raw_edges = spark.createDataFrame(
        [("c", "m", "method", None, None), ("g", "m", "calls", "EXTRACTED", "L7"), ("g", "g", "calls", None, None), ("g", "zzz", "calls", None, None), ("g", "c", "uses", None, "Lx"), ("f2", "pkg.models", "imports", None, None), ("app", "c", "imports_from", None, None), ("f2", "os", "imports", None, None)],
        "source string, target string, relation string, confidence string, source_location string",
    )
    found = raw_graph.prepared(raw_nodes, raw_edges, "/r")
    known = {r["uid"]: r["name"] for r in raw_graph.nodes(found).collect()}
    assert sorted(known.values()) == ["User", "User.save", "go"]
    got = {(known[r["source_uid"]], known[r["target_uid"]], r["relation"], r["confidence"], r["line_number"]) for r in raw_graph.edges(found, raw_edges).collect()}
    assert got == {("User", "User.save", "CONTAINS", "INFERRED", 0), ("go", "User.save", "CALLS", "EXTRACTED", 7), ("go", "User", "CALLS", "INFERRED", 0)}
    assert [tuple(r) for r in raw_graph.imports(found, raw_edges).collect()] == [("/r/a/app.py", "/r/a/models.py")]


def test_stores_round_trip(spark, tmp_path):
    from graphloom.sources import stores

    path = str(tmp_path)
    assert stores.load(spark, path, "edges") is None and stores.load_index(spark, path) is None
    sites = spark.createDataFrame([("a", "f", "b", "g", "local", 9), ("a", "f", "b", "g", "local", 3)], "caller_file string, caller_symbol string, callee_file string, callee_symbol string, call_kind string, call_site_line bigint")
    links = spark.createDataFrame([("x", "y", "uses", {"k": "v"}), ("x", "y", "uses", {"k": "v"})], "src string, dst string, kind string, metadata map<string,string>")
    calls, relations = stores.call_graph(sites, links)
    stores.save(calls, path, "edges")
    stores.save(relations, path, "relations")
    assert [(r["call_site_line"], r["version"]) for r in stores.load(spark, path, "edges").collect()] == [(3, 2)]
    assert [r["metadata"] for r in stores.load(spark, path, "relations").collect()] == [{"k": "v"}]
    stores.save_index(spark.createDataFrame([("1", "a b a")], "id string, text string"), path)
    assert {(r["term"], r["tf"]) for r in stores.load_index(spark, path)[1].collect()} == {("a", 2), ("b", 1)}


def test_package_entries(spark):
    rows = [("/r/packages/a/package.json", '{"name": "@x/a"}'), ("/r/packages/a/index.ts", ""), ("/r/packages/a/src/index.ts", ""), ("/r/packages/a/tsconfig.json", ""), ("/r/packages/b/package.json", "{oops"), ("/r/packages/b/tsconfig.json", ""), ("/r/packages/b/index.ts", "")]
    table = spark.createDataFrame(rows, "path string, text string")
    assert [tuple(r) for r in files.package_entries(table, files.packages(table)).collect()] == [("@x/a", "/r/packages/a/src/index.ts")]


def test_hubs_join_their_neighbours(spark):
    from graphloom.operators import community

    star = [("h", x) for x in "abcdefgh"[:7]] + [("a", "b"), ("b", "c"), ("a", "c")]
    calls = spark.createDataFrame(star, "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefghz"], "uid string")
    edges = community.undirected(calls)
    assert [r["uid"] for r in community.hubs(edges, nodes, 90).collect()] == ["h"]
    found = {r["uid"]: r["community_id"] for r in community.communities(calls, nodes, hub_percentile=90).collect()}
    assert set(found) == set("abcdefghz") and found["h"] == found["a"] == found["b"] == found["c"] != found["z"]


def _modularity(edges, part):
    total, q = 2 * len(edges), 0.0
    for c in set(part.values()):
        inside = sum(2 for a, b in edges if part[a] == part[b] == c)
        mass = sum((part[a] == c) + (part[b] == c) for a, b in edges)
        q += inside / total - (mass / total) ** 2
    return q


def test_communities_reach_the_planted_modularity(spark):
    import random

    from graphloom.operators import community

    rng = random.Random(7)
    planted = {f"n{i:03d}": i % 6 for i in range(180)}
    names = sorted(planted)
    edges = sorted({tuple(sorted((a, b))) for a in names for b in names if a < b and rng.random() < (0.4 if planted[a] == planted[b] else 0.01)})
    table = spark.createDataFrame(edges, "a string, b string")
    found = community.detect(table)
    part = {r["uid"]: r["community"] for r in found.collect()}
    assert set(part) == set(names) and len(set(part.values())) == 6
    assert abs(community.modularity(table, found) - _modularity(edges, part)) < 1e-9
    assert _modularity(edges, part) >= _modularity(edges, planted) - 1e-9


def test_levels_join_small_cliques(spark):
    """A ring of 30 cliques of 4: one level stops at the cliques, the next ones join neighbours."""
    from graphloom.operators import community

    edges = [(f"{c:02d}{a}", f"{c:02d}{b}") for c in range(30) for a in range(4) for b in range(a + 1, 4)] + [tuple(sorted((f"{c:02d}0", f"{(c + 1) % 30:02d}1"))) for c in range(30)]
    part = {r["uid"]: r["community"] for r in community.detect(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(len({part[f"{c:02d}{a}"] for a in range(4)}) == 1 for c in range(30))
    assert _modularity(edges, part) > _modularity(edges, {n: n[:2] for n in part}) and len(set(part.values())) < 30


def test_overlaps_by_brute_force(spark):
    import random

    from graphloom.operators import topology

    rng = random.Random(3)
    sets = {f"c{i}": {f"p{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))} | {"hot"} for i in range(60)}
    members = spark.createDataFrame([(c, p) for c, ps in sets.items() for p in sorted(ps)], "cluster string, path string")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert want and {(r["a"], r["b"]) for r in topology.merged_by_overlap(members).collect()} == want
    merged: dict = {}
    for r in topology.united(members).collect():
        merged.setdefault(r["cluster"], set()).add(r["path"])
    assert all(len(merged[a] & merged[b]) / len(merged[a] | merged[b]) < 0.6 for a in merged for b in merged if a < b)
    apart = spark.createDataFrame([("a", "x"), ("b", "y")], "cluster string, path string")
    assert sorted(map(tuple, topology.united(apart).collect())) == [("a", "x"), ("b", "y")]


def test_places_and_pieces(spark):
    from graphloom.operators import order, search

    rows = spark.createDataFrame([([i % 3, i % 7], i) for i in range(500)], "key array<int>, i int")
    got = [r["i"] for r in order.placed(rows, ["key", "i"]).orderBy("position").collect()]
    assert got == sorted(range(500), key=lambda i: ([i % 3, i % 7], i))
    assert sorted(r["p"] for r in order.placed(rows, ["key", "i"], "p").collect()) == list(range(1, 501))
    assert order.placed(rows.limit(0), ["key"]).isEmpty()
    names = ["abcab", "xab", "b", "", "a.b%c", "\U0001f600é", None, "xab"]
    asked = ["ab", "abcab", "b", "cabz", "", ".b%", "\U0001f600", "a", None]
    table, want = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(q,) for q in asked], "q string")
    got = {(r["q"], r["name"]) for r in search.holding(want, table).collect()}
    assert got == {(q, n) for q in asked for n in names if q and n is not None and q in n}


def test_slugs_are_unique(spark):
    from graphloom.operators import topology

    found = topology.unique_slugs(spark.createDataFrame([("/a/b.py",), ("/a-b.py",)], "seed string"))
    assert sorted(r["cluster_id"] for r in found.collect()) == ["a-b-py", "a-b-py-1"]


def test_equal_points_stay_apart(spark):
    points = spark.createDataFrame([("a", 5), ("a", 5), ("a", 50)], "p string, line int")
    spans = spark.createDataFrame([("a", 1, 9, 0, "f"), ("a", 4, 6, 1, "g")], "p string, s int, e int, seq int, name string")
    found = joins.innermost(points, spans, ["p"], "line", "s", "e").collect()
    assert sorted((r["line"], r["found"] and r["found"]["name"]) for r in found) == [(5, "g"), (5, "g"), (50, None)]


@pytest.mark.parametrize("strict", [False, True])
def test_preceding_in_slices(spark, strict):
    rng = random.Random(4)
    facts = spark.createDataFrame([(rng.choice("ab"), rng.randrange(400), k) for k in range(30)], "p string, line int, name int")
    probes = spark.createDataFrame([(rng.choice("abc"), rng.randrange(400), k) for k in range(200)], "p string, line int, k int")
    run = lambda **x: sorted((r["k"], r["found"] and r["found"]["name"]) for r in joins.preceding(probes, facts, ["p"], "line", F.struct("name"), strict, **x).collect())
    assert run() == run(slices=F.floor(F.col("line") / 7))


def test_routes_of_many_forms(spark):
    rows = [
        ("/r/a.py", '@app.get(\n    "/items/{id}",\n    response_model=Item,\n)\n# note\n@other(\n  1)\nasync def get_item(id):\n    pass\n\n@api.trace("/t")\ndef traced(): pass\n\n@app.route("/f",\n  methods=["PUT"])\ndef put_it(): pass\n@app.get("/none")\nx = 1\ndef far(): pass\n'),
        ("/r/b.ts", "app.get('/x', { preHandler: [a] }, ctl.handler);\nfoo.get('/y', other);\nrouter.POST(`/z`, make)"),
        ("/r/c.go", "r.Get(`/users`, getUsers)\nr.Method(`POST`, `/m`, h.Make)\nmux.HandleFunc(`/any`, any)"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    assert {(r["handler"], r["method"], r["route"], r["line"]) for r in routes.decorated(df).collect()} == {("get_item", "GET", "/items/{id}", 1), ("traced", "TRACE", "/t", 11), ("put_it", "PUT", "/f", 14)}
    assert {(r["handler"], r["method"], r["route"]) for r in routes.scripted(df).collect()} == {("handler", "GET", "/x"), ("make", "POST", "/z")}
    assert {(r["handler"], r["method"], r["route"]) for r in routes.go(df).collect()} == {("getUsers", "GET", "/users"), ("Make", "POST", "/m"), ("any", "ANY", "/any")}


def test_scan_of_odd_trees(spark, tmp_path):
    for p, b in (("a.py", b"x = '\xff\xfe'\n"), ("b.zig", b"z"), ("c.tf", b"t"), ("d.pyi", b"no"), (".git/e.py", b"no"), ("coverage/f.py", b"no"), ("target/g.rs", b"yes"), ("h.h", b"h"), ("i.bash", b"b")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    found = {r["path"].rpartition("/")[2]: (r["text"], r["lang"]) for r in files.repository(spark, str(tmp_path)).withColumn("lang", scalars.language(F.col("path"))).collect()}
    assert set(found) == {"a.py", "b.zig", "c.tf", "g.rs", "h.h", "i.bash"}
    assert found["a.py"][0] == "x = '\ufffd\ufffd'\n" and found["h.h"][1] == "cpp" and found["b.zig"][1] == "zig" and found["i.bash"][1] == "unknown"


def test_types_imports_and_test_files(spark):
    from graphloom.operators import topology

    docs = [["A type of thing", "```ts\ninterface Foo\n```"], ["```rust\ntrait T\n```"], ["```ts\nexport type A = B\n```"], ["the enum of it"], ["```ts\nexport declare const enum E\n```"]]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d array<string>")
    assert [r["t"] for r in df.orderBy("k").select(scip.type_label(F.col("d")).alias("t")).collect()] == ["Interface", "Interface", None, "Class", "Enum"]
    paths = {"x/tests/a.py": True, "tests_of/b.py": True, "src/test_a.py": False, "src/a_spec.ts": True, "src/a_test.py": True, "src/a.test.js": True, "src/a_test.go": False, "src/a.spec.ts": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["t"] for r in df.select("p", topology.is_test(F.col("p")).alias("t")).collect()} == paths
    slugs = spark.createDataFrame([("/repo/app/m1.py",), ("/",)], "p string").select("p", topology.slug(F.col("p")).alias("s"))
    assert {r["p"]: r["s"] for r in slugs.collect()} == {"/repo/app/m1.py": "repo-app-m1-py", "/": "cluster"}


def test_methods_of_far_bases(spark):
    from graphloom.sources import python_source

    text = "class A:\n    def go(self): pass\n" + "".join(f"class {b}({a}): pass\n" for a, b in zip("ABCDEFG", "BCDEFGH")) + "class L(M): pass\nclass M(L): pass\ndef run():\n    x = H()\n    H.go(x)\n"
    found = python_source.facts(spark.createDataFrame([("m.py", text)], "path string, text string"))
    assert ("run", "A.go") in {(r["caller"], r["callee"]) for r in python_source.calls(found).collect()}


SCRIPT = """import { Base, log as note } from './models/base';
import * as util from "../lib/util.js";
import Store from './store'; // import { not } from './comment'

export class Order<T> extends Base {
  private total = 0;
  constructor(private s: Store) { super(s); }
  async save(x: number): Promise<void> {
    if (x > 0) { this.check(x); }
    note(`saved ${x} if (y) {`);
  }
  check = (n) => n;
  get sum() { return util.add(this.total, 1) }
}

export const make = async (id: string): Promise<Order> => {
  const o = new Order(id);
  o.save(1);
  return helper(o);
};
function helper(o) { return o }
const twice = x => helper(x);
"""


def test_scripts_and_go(spark):
    rows = [
        ("/r/src/order.ts", SCRIPT),
        ("/r/src/models/base.ts", "export class Base { check(n) { return n } }\nexport function log(s) { console.log(s) }\n"),
        ("/r/lib/util.js", "module.exports = {}; function add(a, b) { return a + b }\n"),
        ("/r/src/store/index.ts", "export default class Store {}\n"),
        ("/r/pkg/item.go", 'package pkg\n\nimport (\n\t"fmt"\n\th "x/helper"\n)\n\ntype Item struct {\n\tA int\n}\n\nfunc (i *Item) Save() error {\n\ti.check()\n\treturn h.Do(run(1))\n}\n\nfunc (i Item) check() { fmt.Println("run(2) {") }\n'),
        ("/r/pkg/run.go", "package pkg\n\nfunc run(n int) int {\n\treturn n\n}\n"),
        ("/r/helper/do.go", "package helper\n\nfunc Do(n int) error { return nil }\n"),
    ]
    known, links, linked = python_source.graph(spark.createDataFrame(rows, "path string, text string"))
    names = {r["uid"]: r["name"] for r in known.collect()}
    labels = {r["name"]: (r["label"], r["line_number"], r["end_line"]) for r in known.collect()}
    assert set(labels) == {"Order", "Order.constructor", "Order.save", "Order.sum", "make", "helper", "twice", "Base", "Base.check", "log", "add", "Store", "Item", "Item.Save", "Item.check", "run", "Do"}
    assert labels["Order"] == ("Class", 5, 14) and labels["Order.save"] == ("Function", 8, 11) and labels["Item.Save"] == ("Function", 12, 15) and labels["make"][2] == 20
    found = {}
    for r in links.where("drop_reason is null").collect():
        found.setdefault(r["relation"], set()).add((names[r["source_uid"]], names[r["target_uid"]]))
    assert found["CALLS"] == {
        ("Order.save", "Base.check"), ("Order.save", "log"), ("Order.sum", "add"), ("make", "Order"), ("make", "Order.save"), ("make", "helper"), ("twice", "helper"),
        ("Item.Save", "Item.check"), ("Item.Save", "run"), ("Item.Save", "Do"),
    }
    assert found["INHERITS"] == {("Order", "Base")} and ("Item", "Item.Save") in found["CONTAINS"] and ("Order", "Order.sum") in found["CONTAINS"]
    assert {(r["src_path"][3:], r["dst_path"][3:]) for r in linked.collect()} == {("src/order.ts", "src/models/base.ts"), ("src/order.ts", "lib/util.js"), ("src/order.ts", "src/store/index.ts"), ("pkg/item.go", "helper/do.go")}


def test_communities_by_arrays_and_by_jobs_are_the_same(spark, monkeypatch):
    from graphloom.operators import community

    # a hub of many leaves, cliques in a ring, a chain, and names whose order is not that of their numbers
    pairs = [("hub", f"leaf{i}") for i in range(30)] + [(f"p{i}", f"p{i + 1}") for i in range(12)]
    pairs += [(f"c{c}é{i}", f"c{c}é{j}") for c in range(5) for i in range(4) for j in range(i)] + [(f"c{c}é0", f"c{(c + 1) % 5}é1") for c in range(5)]
    edges = spark.createDataFrame(sorted((min(p), max(p)) for p in pairs), "a string, b string")
    rows = lambda: {r["uid"]: r["community"] for r in community.detect(edges).collect()}
    found = rows()
    assert set(found) == {x for p in pairs for x in p} and set(found.values()) <= set(found)
    assert len({found[f"leaf{i}"] for i in range(30)} | {found["hub"]}) == 1
    monkeypatch.setattr(community, "LOCAL", 0)
    assert rows() == found


def test_communities_take_few_turns(spark, monkeypatch):
    from graphloom.operators import community

    taken = []
    level = community._level
    monkeypatch.setattr(community, "_level", lambda start, take, judge: level(start, lambda s, t: taken.append(t) or take(s, t), judge))
    import numpy as np

    rng = np.random.default_rng(5)
    links = np.unique(np.sort(rng.integers(0, 20_000, (20_000, 2)), 1), axis=0)
    links = links[links[:, 0] != links[:, 1]]
    label = community._by_arrays(links[:, 0], links[:, 1], 20_000)
    assert len(taken) < 500 and len(set(label.tolist())) < 10_000
