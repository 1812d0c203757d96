"""TypeScript, JavaScript and Go sources: the facts that :mod:`python_source` has of Python ones.

A file's strings and comments are blanked, its braces paired, and definitions, calls and imports are found by pattern;
what stands in which body follows from the pairs. No types are inferred but those of ``new`` and of Go receivers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

SCRIPTS = r"\.(?:ts|tsx|js|jsx|mjs|cjs)$"
_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_WORDS = frozenset("if for while switch catch function return typeof await new import super constructor func go defer select range make append len cap panic recover print println string int".split()) - {"constructor"}

_ARGS = r"\((?:[^()]|\([^()]*\))*\)"
_SCRIPT_DEF = re.compile(
    rf"\b(?:class|interface)\s+(?P<type>[A-Za-z_$][\w$]*)(?P<head>[^{{;]*)(?=\{{)"
    rf"|\bfunction\b\s*\*?\s*(?P<function>[A-Za-z_$][\w$]*)\s*(?:<[^>()]*>)?\s*{_ARGS}[^{{;=]*(?=\{{)"
    rf"|\b(?:const|let|var)\s+(?P<value>[A-Za-z_$][\w$]*)\s*(?::[^=;]*)?=\s*(?:async\s+)?(?:function\b[^{{]*(?=\{{)|(?:{_ARGS}|[A-Za-z_$][\w$]*)\s*(?::[^=;{{]*)?=>\s*)"
    rf"|(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*[*#]?(?P<method>[A-Za-z_$][\w$]*)\s*(?:<[^>()]*>)?{_ARGS}\s*(?::[^{{;=]*)?(?=\{{)",
    re.M,
)
_GO_DEF = re.compile(rf"^func\s+(?:\(\s*(?P<self>\w+)?\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<function>\w+)\s*(?:\[[^\]]*\])?{_ARGS}[^\n{{]*(?=\{{)|^type\s+(?P<type>\w+)\s+(?:struct|interface)\s*(?=\{{)", re.M)
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?:(?P<of>[A-Za-z_$][\w$]*|[)\]])\s*\??\.\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.\[\]]*>)?\(")
_MADE = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]*)?=\s*new\s+([\w$]+)")
_IMPORTS = re.compile(r"\bimport\s+(?:type\s+)?([^;'\"()]+?)\s+from\s+['\"](\.[^'\"]*)['\"]|\b(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"](\.[^'\"]*)['\"]")
_GO_IMPORTS = re.compile(r"^import\s+(?:\(([^)]*)\)|((?:\w+\s+)?\"[^\"]+\"))", re.M)
_GO_IMPORT = re.compile(r"(?:(\w+|\.)\s+)?\"([^\"]+)\"")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _pairs(code: str) -> dict[int, int]:
    """Where each opening brace is closed; the end of the text for one that is not."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out | dict.fromkeys(stack, len(code))


def _script_imports(text: str) -> list[tuple[int, str, str, str, str]]:
    """position, local name, form, name in the module, module's last name."""
    out = []
    for m in _IMPORTS.finditer(text):
        what, where = (m[1], m[2]) if m[1] else (m[3], m[4])
        module = re.sub(r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "", where.rstrip("/").rpartition("/")[2])
        braces = re.search(r"\{([^}]*)\}", what)
        for part in braces[1].split(",") if braces else ():
            names = re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^\s*type\s+", "", part).strip())
            if names[0]:
                out.append((m.start(), names[-1], "symbol", names[0], module))
        for part in re.sub(r"\{[^}]*\}", "", what).split(","):
            if star := re.match(r"\s*\*\s*as\s+([\w$]+)", part):
                out.append((m.start(), star[1], "module", "", module))
            elif name := part.strip():
                # a default export is known by the name it is given, a required module as a module
                out.append((m.start(), name, "symbol" if m[1] else "module", name if m[1] else "", module))
    return out


def _go_imports(text: str) -> list[tuple[int, str, str, str, str]]:
    out = []
    for m in _GO_IMPORTS.finditer(text):
        for x in _GO_IMPORT.finditer(m[1] or m[2]):
            last = x[2].rpartition("/")[2]
            out.append((m.start(1 if m[1] else 2) + x.start(), x[1] or last, "module", "", last))
    return out


def read(path: str, text: str) -> list[tuple]:
    """The facts of one file, as rows of ``python_source.FACTS``."""
    go = path.endswith(".go")
    code, out = _QUIET.sub(_blank, text), []
    ends = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(ends, at - 1) + 1
    closed = _pairs(code)
    defs = list((_GO_DEF if go else _SCRIPT_DEF).finditer(code))
    heads = {m.start(g) for m in defs for g in ("function", "method", "type", "value") if g in m.re.groupindex and m[g]}
    events = sorted([(m.start(), 0, m) for m in defs] + [(m.start("name"), 1, m) for m in _CALL.finditer(code)], key=lambda e: e[:2])
    open_: list[tuple[int, str, str, dict]] = []  # end, kind, name, types of names
    for at, kind, m in events:
        while open_ and open_[-1][0] <= at:
            open_.pop()
        owner = next((n for _, k, n, _ in reversed(open_) if k == "type"), "")
        if kind == 0:
            g = {k: v for k, v in m.groupdict().items() if v is not None}
            name = g.get("type") or g.get("function") or g.get("value") or g.get("method")
            if "method" in g and (not open_ or open_[-1][1] != "type" or name in _WORDS):
                continue
            body = m.end()
            end = closed.get(body)
            if end is None:  # an arrow with an expression: to the end of its line
                end = next((e for e in ends[bisect_right(ends, body) :][:1]), len(code))
            first, last = line(m.start() + len(m[0]) - len(m[0].lstrip())), line(end - 1)
            if "type" in g:
                out.append((path, "def", name, first, last, "Class", "", "", ""))
                for base in re.findall(r"\bextends\s+([\w$.]+)", g.get("head", "")):
                    out.append((path, "base", name, first, last, "", "", "", base.rpartition(".")[2]))
                open_.append((end, "type", name, {}))
                continue
            of = g.get("owner") or (owner if "method" in g else "")
            full = f"{of}.{name}" if of else name
            out.append((path, "def", full, first, last, "Function", "", "", ""))
            if of:
                out.append((path, "method", full, first, last, "", "", of, ""))
            types = dict(x.groups() for x in _MADE.finditer(code, body, end))
            if "self" in g:
                types[g["self"]] = of
            open_.append((end, "function", full, types))
            continue
        name, of = m["name"], m["of"]
        caller = next(((n, t) for _, k, n, t in reversed(open_) if k == "function"), None)
        if caller is None or m.start("name") in heads or of in (")", "]") or (of is None and name in _WORDS):
            continue
        before = code[max(0, m.start() - 2) : m.start()].rstrip()
        if of is None and before.endswith("."):
            continue
        if of in ("this", "super"):
            form, whose = ("method" if of == "this" else "super"), owner or caller[0].rpartition(".")[0]
        elif of is None:
            form, whose = "name", ""
        else:
            made = caller[1].get(of)
            form, whose = ("method", made) if made else ("method" if of[:1].isupper() else "module", of)
        if form in ("name", "module") or whose:
            out.append((path, "call", caller[0], line(m.start("name")), line(m.start("name")), "", form, whose, name))
    for at, name, form, own, module in (_go_imports if go else _script_imports)(text):
        out.append((path, "import", name, line(at), line(at), "", form, own, module))
    return out


def facts(files: DataFrame) -> DataFrame:
    """All facts of the script and Go files (path, text)."""
    from .python_source import FACTS

    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["text"], strict=True) for r in read(path, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.where(F.col("path").rlike(rf"{SCRIPTS}|\.go$")).select("path", "text").mapInPandas(run, FACTS)
