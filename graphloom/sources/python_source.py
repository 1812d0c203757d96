"""Python sources: definitions, calls, imports and bases by syntax tree, and calls resolved by joins.

Each file is parsed alone (``mapInPandas``); everything between files is joins on names and paths.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import language
from ..model import uid
from ..operators.writing import classified
from ..session import cut, ship
from . import braced_source

FACTS = "path string, kind string, name string, line long, end_line long, label string, form string, owner string, target string"


class _Reader(ast.NodeVisitor):
    """Facts of one module. Names bound to one class's constructor are typed; a second class unbinds them."""

    def __init__(self, path: str):
        self.path, self.rows = path, []
        self.scope: list[str] = []
        self.classes: list[str] = []
        self.types: list[dict[str, str | None]] = [{}]
        self.attributes: dict[str, dict[str, str | None]] = {}

    def add(self, kind, name, node, label="", form="", owner="", target=""):
        self.rows.append((self.path, kind, name, node.lineno, getattr(node, "end_lineno", None) or node.lineno, label, form, owner, target))

    @staticmethod
    def bind(table, name, made):
        table[name] = made if table.get(name, made) == made else None

    @staticmethod
    def maker(value) -> str | None:
        if isinstance(value, ast.Call):
            f = value.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            if name[:1].isupper():
                return name
        return None

    @staticmethod
    def noted(annotation) -> str | None:
        if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
            return annotation.value.rpartition(".")[2]
        return annotation.id if isinstance(annotation, ast.Name) and annotation.id[:1].isupper() else None

    def visit_ClassDef(self, node):  # noqa: N802
        name = node.name
        self.add("def", name, node, label="Class")
        for b in node.bases:
            if isinstance(b, (ast.Name, ast.Attribute)):
                self.add("base", name, node, target=b.id if isinstance(b, ast.Name) else b.attr)
        attributes = self.attributes.setdefault(name, {})
        for sub in ast.walk(node):
            if isinstance(sub, ast.Assign) and (made := self.maker(sub.value)):
                for t in sub.targets:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                        self.bind(attributes, t.attr, made)
        self.classes.append(name)
        self.scope.append(name)
        self.generic_visit(node)
        self.scope.pop()
        self.classes.pop()

    def visit_FunctionDef(self, node):  # noqa: N802
        method = bool(self.classes) and bool(self.scope) and self.scope[-1] == self.classes[-1]
        name = f"{self.classes[-1]}.{node.name}" if method else node.name
        self.add("def", name, node, label="Function")
        if method:
            self.add("method", name, node, owner=self.classes[-1])
        types: dict[str, str | None] = {}
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation is not None and (made := self.noted(a.annotation)):
                types[a.arg] = made
        for sub in ast.walk(node):
            if isinstance(sub, ast.Assign):
                for t in sub.targets:
                    if isinstance(t, ast.Name):
                        self.bind(types, t.id, self.maker(sub.value) or "")
        self.types.append(types)
        self.scope.append(name)
        for d in node.decorator_list:
            self.visit(d)
        for s in node.body:
            self.visit(s)
        self.scope.pop()
        self.types.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Import(self, node):  # noqa: N802
        for a in node.names:
            self.add("import", a.asname or a.name.partition(".")[0], node, form="module", target=a.name)

    def visit_ImportFrom(self, node):  # noqa: N802
        for a in node.names:
            self.add("import", a.asname or a.name, node, form="symbol", owner=a.name, target=node.module or "")

    def visit_Call(self, node):  # noqa: N802
        self.generic_visit(node)
        caller = next((s for s in reversed(self.scope) if s not in self.classes), None)
        if caller is None:
            return
        f, own = node.func, self.classes[-1] if self.classes else ""
        if isinstance(f, ast.Name):
            self.add("call", caller, node, form="name", target=f.id)
        elif isinstance(f, ast.Attribute):
            v = f.value
            if isinstance(v, ast.Name) and v.id in ("self", "cls") and own:
                self.add("call", caller, node, form="method", owner=own, target=f.attr)
            elif isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super" and own:
                self.add("call", caller, node, form="super", owner=own, target=f.attr)
            elif isinstance(v, ast.Call) and (made := self.maker(v)):
                self.add("call", caller, node, form="method", owner=made, target=f.attr)
            elif isinstance(v, ast.Name):
                made = self.types[-1].get(v.id)
                if made:
                    self.add("call", caller, node, form="method", owner=made, target=f.attr)
                elif made is None and v.id not in self.types[-1]:
                    self.add("call", caller, node, form="method" if v.id[:1].isupper() else "module", owner=v.id, target=f.attr)
            elif isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.value.id == "self" and own:
                made = self.attributes.get(own, {}).get(v.attr)
                if made:
                    self.add("call", caller, node, form="method", owner=made, target=f.attr)


def facts(files: DataFrame) -> DataFrame:
    """All facts of the Python files (path, text); files that do not parse give none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                reader = _Reader(path)
                try:
                    reader.visit(ast.parse(text or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += reader.rows
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, FACTS)


def nodes(found: DataFrame) -> DataFrame:
    d = found.where("kind = 'def'")
    return d.select(uid(F.col("name"), F.col("path"), F.col("line")).alias("uid"), "label", "name", "path", F.col("line").alias("line_number"), "end_line", language(F.col("path")).alias("lang"))


def _family(path):
    """Files that can import each other."""
    return F.when(path.endswith(".py"), "python").when(path.endswith(".go"), "go").otherwise("script")


def _module(path):
    """The last name by which a file is imported: Go packages are folders, an index file stands for its folder."""
    stem, folder = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(path.endswith(".go") | ((_family(path) == "script") & (stem == "index")), folder).otherwise(stem)


def imports(found: DataFrame) -> DataFrame:
    """src_path, dst_path, name, owner, form: imports of modules that are among the files, by their last name. Of
    files of one name the last is meant, of a Go package all."""
    at = F.col("path")
    modules = found.select("path").distinct().select(_family(at).alias("family"), _module(at).alias("stem"), "path")
    one = modules.where("family <> 'go'").groupBy("family", "stem").agg(F.max("path").alias("dst_path"))
    modules = one.unionByName(modules.where("family = 'go'").withColumnRenamed("path", "dst_path"))
    rows = found.where("kind = 'import'").withColumns({"stem": F.substring_index("target", ".", -1), "family": _family(at)})
    return rows.join(modules, ["family", "stem"]).where("path <> dst_path").select(F.col("path").alias("src_path"), "dst_path", "name", "owner", "form", "line")


def _classes(found: DataFrame, linked: DataFrame) -> DataFrame:
    """path, name -> at, class: the classes that a file can name, its own first."""
    own = found.where("kind = 'def' and label = 'Class'").select("path", "name", F.col("path").alias("at"), F.col("name").alias("class"), F.lit(0).alias("far"))
    known = own.select(F.col("at").alias("dst_path"), F.col("class").alias("owner"))
    other = linked.where("form = 'symbol'").join(known, ["dst_path", "owner"]).select(F.col("src_path").alias("path"), "name", F.col("dst_path").alias("at"), F.col("owner").alias("class"), F.lit(1).alias("far"))
    return own.unionByName(other).groupBy("path", "name").agg(F.min(F.struct("far", "at", "class")).alias("s")).select("path", "name", "s.at", "s.class")


def _above(up: DataFrame) -> DataFrame:
    """at, class, to_at, to, far: every class above a class, through first bases, until nothing new is found."""
    level = cut(up.withColumn("far", F.lit(1)))
    every = level
    while not level.isEmpty():
        step = up.select(F.col("at").alias("to_at"), F.col("class").alias("to"), F.col("to_at").alias("n_at"), F.col("to").alias("n"))
        higher = level.join(step, ["to_at", "to"]).select("at", "class", F.col("n_at").alias("to_at"), F.col("n").alias("to"), (F.col("far") + 1).alias("far"))
        level = cut(higher.join(every, ["at", "class", "to_at", "to"], "left_anti").distinct())
        every = every.unionByName(level)
    return every


def calls(found: DataFrame) -> DataFrame:
    """source_uid, target_uid, caller, callee, line_number, call_kind: every call whose target is known.

    Free names are the file's own or imported; methods are looked for in the named class and then in its
    first bases, up to the last.
    """
    found = cut(found)
    linked = imports(found)
    classes = _classes(found, linked)
    defs = found.where("kind = 'def'").select(F.col("path").alias("at"), "name", "label", F.col("line").alias("def_line"))
    defs = defs.groupBy("at", "name").agg(F.min(F.struct("def_line", "label")).alias("s")).select("at", "name", "s.label", "s.def_line")
    sites = found.where("kind = 'call'").select("path", F.col("name").alias("caller"), "line", "form", "owner", "target")
    own = sites.where("form = 'name'").select("path", "caller", "line", F.col("path").alias("at"), F.col("target").alias("name"), F.lit(0).alias("far"))
    names = linked.where("form = 'symbol'").select(F.col("src_path").alias("path"), F.col("name").alias("target"), F.col("dst_path").alias("at"), F.col("owner").alias("name"))
    other = sites.where("form = 'name'").join(names, ["path", "target"]).select("path", "caller", "line", "at", "name", F.lit(1).alias("far"))
    modules = linked.where("form = 'module'").select(F.col("src_path").alias("path"), F.col("name").alias("owner"), F.col("dst_path").alias("at"))
    through = sites.where("form in ('module', 'method')").join(modules, ["path", "owner"]).select("path", "caller", "line", "at", F.col("target").alias("name"), F.lit(0).alias("far"))
    # names of a Go package are known in all its files
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "").alias("folder")
    package = found.where("kind = 'def' and path like '%.go'").select(folder("path"), F.col("path").alias("at"), F.col("name").alias("target"))
    beside = sites.where("form = 'name' and path like '%.go'").withColumn("folder", folder("path")).join(package, ["folder", "target"])
    found_calls = own.unionByName(other).unionByName(through).unionByName(beside.select("path", "caller", "line", "at", F.col("target").alias("name"), F.lit(1).alias("far")))
    bases = found.where("kind = 'base'").select("path", F.col("name").alias("class"), F.col("target").alias("name"), "line")
    up = bases.join(classes.select("path", "name", F.col("at").alias("to_at"), F.col("class").alias("to")), ["path", "name"]).groupBy(F.col("path").alias("at"), "class").agg(F.min(F.struct("to_at", "to")).alias("s")).select("at", "class", "s.to_at", "s.to")
    typed = sites.where("form in ('method', 'super')").join(classes.select("path", F.col("name").alias("owner"), "at", "class"), ["path", "owner"])
    above = _above(up)
    own_class = typed.where("form = 'method'").select("path", "caller", "line", "at", F.concat_ws(".", "class", "target").alias("name"), F.lit(0).alias("far"))
    higher = typed.join(above, ["at", "class"]).select("path", "caller", "line", F.col("to_at").alias("at"), F.concat_ws(".", "to", "target").alias("name"), "far")
    found_calls = found_calls.unionByName(own_class).unionByName(higher)
    hit = found_calls.join(defs, ["at", "name"]).groupBy("path", "caller", "line", F.substring_index("name", ".", -1).alias("bare")).agg(F.min(F.struct("far", "at", "name", "def_line")).alias("t"))
    source = defs.select(F.col("at").alias("path"), F.col("name").alias("caller"), F.col("def_line").alias("caller_line"))
    out = hit.join(source, ["path", "caller"])
    rows = out.select(
        uid(F.col("caller"), F.col("path"), F.col("caller_line")).alias("source_uid"),
        uid(F.col("t.name"), F.col("t.at"), F.col("t.def_line")).alias("target_uid"),
        "caller",
        F.col("t.name").alias("callee"),
        F.col("line").alias("line_number"),
        F.lit("resolved").alias("call_kind"),
    )
    return rows.where("source_uid <> target_uid").dropDuplicates(["source_uid", "target_uid", "line_number"])


def superseded(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """``edges`` (source_uid, callee, ...) without those that a resolved call of the same bare name replaces."""
    bare = F.substring_index("callee", ".", -1)
    gone = resolved.select("source_uid", bare.alias("_bare")).distinct()
    return edges.withColumn("_bare", bare).join(gone, ["source_uid", "_bare"], "left_anti").drop("_bare").unionByName(resolved, allowMissingColumns=True)


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, judged edges (calls, inheritance, containment) and imports of Python, script and Go sources."""
    found = cut(facts(files).unionByName(braced_source.facts(files)))
    known = nodes(found)
    own = known.select(F.col("uid").alias("class_uid"), "path", "name")
    contains = found.where("kind = 'method'").select("path", "owner", uid(F.col("name"), F.col("path"), F.col("line")).alias("target_uid")).join(own.withColumnRenamed("name", "owner"), ["path", "owner"])
    links = calls(found).select("source_uid", "target_uid", F.lit("CALLS").alias("relation"), "line_number")
    links = links.unionByName(contains.select(F.col("class_uid").alias("source_uid"), "target_uid", F.lit("CONTAINS").alias("relation"), F.lit(0).cast("long").alias("line_number")))
    at = _classes(found, imports(found)).select("path", F.col("name").alias("target"), "at", "class")
    bases = found.where("kind = 'base'").join(at, ["path", "target"]).join(own.select("path", F.col("class_uid").alias("source_uid"), "name"), ["path", "name"])
    heirs = bases.join(own.select(F.col("path").alias("at"), F.col("name").alias("class"), F.col("class_uid").alias("target_uid")), ["at", "class"])
    links = links.unionByName(heirs.select("source_uid", "target_uid", F.lit("INHERITS").alias("relation"), F.lit(0).cast("long").alias("line_number")))
    return known, classified(links, known), imports(found)


def unseen_suffixes(files: DataFrame, known: DataFrame) -> DataFrame:
    """suffix, files: code files whose suffix gave no node, the six most frequent."""
    ext = lambda df: df.withColumn("suffix", F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return ext(files.select("path")).join(ext(known.select("path")).select("suffix").distinct(), "suffix", "left_anti").groupBy("suffix").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "suffix").limit(6)
