"""HTTP routes and task dispatches, found in the lines of source files.

Input is a table of files (path, text); lines are exploded in place, so a file's rows stay together without a shuffle
until a window needs them by path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Verbs of routes, and those that Python decorators know besides.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
MORE = ("trace", "connect")
# What scripts call the thing that routes are registered on.
RECEIVERS = ("plugin", "fastify", "app", "server", "router")
#: Lines below a decorator in which its function must begin.
REACH = 11


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "text")).select("path", (F.col("n") + 1).cast("long").alias("line"), "text")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_MARK = re.compile(rf"^[ \t]*@[\w.]+\.({'|'.join((*VERBS, *MORE))}|route)\s*\(\s*[rf]?[\"']([^\"']*)[\"']", re.M | re.I)
_METHODS = re.compile(r"methods\s*=\s*[\[(]\s*[\"'](\w+)[\"']")
_DEF = re.compile(r"\s*(?:async\s+)?def\s+(\w+)")


def _line_after(code: str, begin: int) -> int:
    """Number (from 0) of the line after the call whose parenthesis opens at or after ``begin``."""
    depth = 0
    for m in re.compile(r"[()]").finditer(code, begin):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return code.count("\n", 0, m.end()) + 1
    return code.count("\n") + 1


def _python_routes(text: str) -> list[tuple[str, str, str, int]]:
    """handler, method, route, line of the decorators of a source, of one line or more."""
    code = re.sub(r"#[^\n]*", "", text.replace("\r\n", "\n"))
    rows, begins, out = code.split("\n"), [0], []
    for r in rows:
        begins.append(begins[-1] + len(r) + 1)
    for m in _MARK.finditer(code):
        at = code.count("\n", 0, m.end(1))
        k = _line_after(code, m.end(1))
        named = _METHODS.search(code, m.end(), begins[min(k, len(rows))])
        method = m[1].upper() if m[1].lower() != "route" else named[1].upper() if named else "GET"
        last = k + REACH - 1
        while k < min(last, len(rows)):
            if rows[k].lstrip().startswith("@"):
                k = _line_after(code, begins[k]) if "(" in rows[k] else k + 1
            elif not rows[k].strip():
                k += 1
            else:
                if (d := _DEF.match(rows[k])) and method.lower() in (*VERBS, *MORE):
                    out.append((d[1], method, m[2], at + 1))
                break
    return out


def decorated(files: DataFrame) -> DataFrame:
    """path, handler, method, route, line: Python routes by decorator. The handler is the first function within the
    next lines, if only blank lines and decorators stand between."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *r) for path, text in zip(batch["path"], batch["text"], strict=True) for r in _python_routes(text or "")]
            yield pd.DataFrame(rows, columns=["path", "handler", "method", "route", "line"])

    out = files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, "path string, handler string, method string, route string, line long")
    return first_of(out, ["path", "handler"], ["line"])


def falcon(files: DataFrame) -> DataFrame:
    """class, route: ``add_route('/p', Class(...))``; with a prefix variable before the path, ``{prefix}/p``."""
    pattern = r"\.add_route\(\s*(?:(\w+)\s*\+\s*)?f?[\"']([^\"']*)[\"']\s*,\s*(?:[\w.]+\.)?(\w+)\s*\("
    hits = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "prefix"), (2, "route"), (3, "class"))))
    rows = files.where(F.col("path").endswith(".py")).select("path", F.posexplode(hits).alias("n", "h"))
    route = F.when(F.col("h.prefix") != "", F.concat(F.lit("{"), "h.prefix", F.lit("}"), "h.route")).otherwise(F.col("h.route"))
    return first_of(rows.select("path", "n", F.col("h.class").alias("class"), route.alias("route")), ["class"], ["path", "n"])


def falcon_methods(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """path, name, method, route: ``Class.on_get`` of a routed class."""
    verb = F.regexp_extract("name", r"^(\w+)\.on_(get|post|put|patch|delete|head|options)$", 2)
    named = functions.withColumn("verb", verb).where("verb <> ''").withColumn("class", F.substring_index("name", ".", 1))
    return named.join(classes.select("class", "route"), "class").select("path", "name", F.upper("verb").alias("method"), "route")


def scripted(files: DataFrame) -> DataFrame:
    """path, handler, method, route: ``app.get('/p', handler)`` in scripts, first of each handler."""
    ext = F.regexp_extract("path", r"\.(ts|tsx|js|jsx|mjs)$", 1)
    # an options object may stand before the handler
    pattern = rf"\b(?:{'|'.join(RECEIVERS)})\.((?i:{'|'.join(VERBS)}))\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*(?:,\s*\{{[^}}]*\}})?\s*,\s*(?:[\w.]+\s*,\s*)*([A-Za-z_][\w.]*)"
    hits = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "verb"), (2, "route"), (3, "handler"))))
    rows = files.where(ext != "").select("path", F.posexplode(hits).alias("n", "h"))
    rows = rows.select("path", "n", F.substring_index("h.handler", ".", -1).alias("handler"), F.upper("h.verb").alias("method"), F.col("h.route").alias("route"))
    return first_of(rows, ["path", "handler"], ["n"]).drop("n")


_GO_NAMED = re.compile(r"\.(?:Method|Handle)\(\s*(?:http\.Method(\w+)|[\"`](\w+)[\"`])\s*,\s*[\"`]([^\"`]*)[\"`]\s*,\s*([\w.]+)")
_GO_VERB = re.compile(r"\b(\w+)\.(Get|Post|Put|Patch|Delete|Head|Options|Connect|Trace|GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\(\s*[\"`]([^\"`]*)[\"`]\s*,\s*([\w.]+)")
_GO_ANY = re.compile(r"\.(?:HandleFunc|Handle)\(\s*[\"`]([^\"`]*)[\"`]\s*,\s*([\w.]+)")


def go(files: DataFrame) -> DataFrame:
    """path, handler, method, route of Go sources: named methods first, whose text then counts no more; verb methods
    but those of ``http``; ``Handle`` and ``HandleFunc`` of the standard library as ANY."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                text, taken = re.sub(r"//[^\n]*", "", text or ""), []
                found: dict[str, tuple[str, str]] = {}

                def free(m, taken=taken):
                    return all(m.end() <= a or b <= m.start() for a, b in taken)

                for m in _GO_NAMED.finditer(text):
                    taken.append(m.span())
                    found.setdefault(m[4].rpartition(".")[2], ((m[1] or m[2]).upper(), m[3]))
                for m in _GO_VERB.finditer(text):
                    if m[1] != "http" and free(m):
                        taken.append(m.span())
                        found.setdefault(m[4].rpartition(".")[2], (m[2].upper(), m[3]))
                for m in _GO_ANY.finditer(text):
                    if free(m):
                        found.setdefault(m[2].rpartition(".")[2], ("ANY", m[1]))
                rows += [(path, h, *r) for h, r in found.items()]
            yield pd.DataFrame(rows, columns=["path", "handler", "method", "route"])

    return files.where(F.col("path").endswith(".go")).select("path", "text").mapInPandas(run, "path string, handler string, method string, route string")


def dispatches(files: DataFrame) -> DataFrame:
    """path, line, target: ``task.delay(`` and ``task.apply_async(`` outside comments."""
    code = lines(files.where(F.col("path").endswith(".py"))).withColumn("code", F.regexp_replace("text", "#.*$", ""))
    found = F.regexp_extract_all("code", F.lit(r"([\w.]+)\.(?:apply_async|delay)\("), F.lit(1))
    return code.select("path", "line", F.explode(found).alias("target")).withColumn("target", F.substring_index("target", ".", -1)).distinct()
