"""Scalar functions as column expressions."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extension -> language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mjs": "javascript",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "rb": "ruby", "php": "php", "swift": "swift",
    "cs": "csharp", "cpp": "cpp", "c": "c", "h": "cpp", "lua": "lua", "zig": "zig", "ex": "elixir", "exs": "elixir",
    "hs": "haskell", "dart": "dart", "sh": "bash", "sql": "sql",
}
# Extensions of code files.
CODE = (
    "py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "go", "rs", "java", "kt", "scala", "groovy", "c", "h", "cpp", "cc", "cxx", "hpp",
    "cs", "rb", "php", "swift", "lua", "zig", "ex", "exs", "hs", "dart", "sh", "bash", "tf", "hcl", "sql",
)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit("unknown"))


def symbol_name(raw: Column) -> Column:
    """A raw label without a trailing call and a leading dot."""
    return F.regexp_replace(F.regexp_replace(raw, r"[()]+$", ""), r"^\.+", "")


def inferred_label(raw: Column) -> Column:
    return F.when(raw.endswith("()"), "Function").when(symbol_name(raw).rlike(r"^\p{Lu}"), "Class").otherwise("Function")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def line_label(label: Column) -> Column:
    """The number of ``L123``."""
    return F.regexp_extract(label, r"^L(\d+)$", 1).try_cast("bigint")


def contains_literally(column: Column, term: str) -> Column:
    """Case-blind search of a term, every sign of it literal."""
    return F.lower(column).contains(term.lower())


def truncated(text: Column, signs: int, lines: int | None = None) -> Column:
    kept = text if lines is None else F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    return F.substring(kept, 1, signs)


@F.pandas_udf(StringType())
def canonical(path: pd.Series) -> pd.Series:
    """A path without ``.`` and ``..`` steps."""
    return path.map(lambda p: None if p is None else posixpath.normpath(p))


# Relations of the extractor and what they are stored as; all others are calls.
RELATION_OF = {
    "calls": "CALLS", "references": "CALLS", "imports": "IMPORTS", "imports_from": "IMPORTS", "inherits": "INHERITS", "extends": "INHERITS",
    "embeds": "INHERITS", "mixes_in": "INHERITS", "implements": "IMPLEMENTS", "contains": "CONTAINS", "method": "CONTAINS",
}


def relation(raw: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in RELATION_OF.items() for x in pair))
    return F.coalesce(F.try_element_at(known, raw), F.lit("CALLS"))
