"""Compiler indexes: a decoder of the index format's wire encoding, and symbols and references by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import uid
from ..operators.joins import innermost
from ..session import ship

OCCURRENCES = "doc string, seq long, range array<int>, symbol string, roles int, enclosing array<int>"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            if i + n > len(b):
                raise IndexError
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def _ints(values: list) -> list[int]:
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
        else:
            i = 0
            while i < len(v):
                x, i = _varint(v, i)
                out.append(x)
    return out


# Numbers of the format's fields. Index: documents 2. Document: path 1, occurrences 2, symbols 3.
# Occurrence: range 1, symbol 2, roles 3, enclosing range 7. Symbol: name 1, documentation 3, relationships 4.
# Relationship: symbol 1, implementation 3.
def occurrences(indexes: DataFrame) -> DataFrame:
    """Every occurrence in binary indexes (content); an index that cannot be read gives none."""
    ship(indexes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                own, seq = [], 0
                try:
                    for n, doc in fields(bytes(content)):
                        if n != 2:
                            continue
                        parts = list(fields(doc))
                        path = next((v.decode() for k, v in parts if k == 1), "")
                        for k, v in parts:
                            if k == 2:
                                f = list(fields(v))
                                get = lambda num, f=f: [x for k2, x in f if k2 == num]
                                symbol = (get(2) or [b""])[-1].decode()
                                own.append((path, seq, _ints(get(1)), symbol, (get(3) or [0])[-1], _ints(get(7)) or None))
                                seq += 1
                except (IndexError, UnicodeDecodeError, AttributeError):
                    continue
                rows += own
            yield pd.DataFrame(rows, columns=["doc", "seq", "range", "symbol", "roles", "enclosing"])

    return indexes.select("content").mapInPandas(run, OCCURRENCES)


def symbols(indexes: DataFrame) -> DataFrame:
    """symbol, documentation, implements (array) of binary indexes."""
    ship(indexes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                own = []
                try:
                    for n, doc in fields(bytes(content)):
                        for k, v in fields(doc) if n == 2 else ():
                            if k == 3:
                                f = list(fields(v))
                                relations = [dict(fields(x)) for k2, x in f if k2 == 4]
                                own.append((next((x.decode() for k2, x in f if k2 == 1), ""), [x.decode() for k2, x in f if k2 == 3], [r[1].decode() for r in relations if r.get(3)]))
                except (IndexError, UnicodeDecodeError, AttributeError):
                    continue
                rows += own
            yield pd.DataFrame(rows, columns=["symbol", "documentation", "implements"])

    return indexes.select("content").mapInPandas(run, "symbol string, documentation array<string>, implements array<string>")


def name_of(symbol: Column) -> Column:
    """The last name of a descriptor, with its class where it is a member."""
    tail = F.element_at(F.split(F.regexp_replace(symbol, r"[`]", ""), r"[\s/]"), -1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"\([^)]*\)", ""), r"[.:]+$|#$", ""), "#", ".")


def coarse_label(symbol: Column) -> Column:
    """Function, Type, or null for what is no node."""
    return F.when(symbol.startswith("local ") | symbol.endswith("/"), None).when(symbol.rlike(r"\([^)]*\)\.$"), "Function").when(symbol.endswith("#"), "Type")


def is_arrow(documentation: Column) -> Column:
    return F.exists(documentation, lambda d: d.rlike(r"(?<![=!<>])=>"))


#: A type's declaration at the beginning of a quoted piece of code.
_DECLARED = r"```[a-z]*\s*(?:(?:export|declare|default|abstract|const)\s+)*(class|interface|enum|struct|trait|type|namespace)\b"


def type_label(documentation: Column) -> Column:
    """Class, Interface, Enum or Struct by the first quoted declaration; null for aliases; Class without one."""
    word = F.regexp_extract(F.array_join(documentation, "\n"), _DECLARED, 1)
    return F.when(word.isin("interface", "trait"), "Interface").when(word == "enum", "Enum").when(word == "struct", "Struct").when(word.isin("type", "namespace"), None).otherwise("Class")


def nodes(found: DataFrame, info: DataFrame) -> DataFrame:
    """uid, symbol, label, name, path, line_number, end_line of every definition (lines from 1)."""
    rows = found.where("(roles & 1) = 1 and not startswith(symbol, 'local ')").join(info.select("symbol", "documentation"), "symbol", "left")
    docs = F.coalesce("documentation", F.expr("cast(array() as array<string>)"))
    coarse = coarse_label(F.col("symbol"))
    arrow = F.col("symbol").endswith(".") & is_arrow(docs)
    label = F.when(coarse == "Type", type_label(docs)).when((coarse == "Function") | arrow, "Function")
    end = F.when(F.size("enclosing") >= 4, F.col("enclosing")[2]).otherwise(F.coalesce(F.col("enclosing")[0], F.col("range")[0]))
    out = rows.select("symbol", label.alias("label"), name_of(F.col("symbol")).alias("name"), F.col("doc").alias("path"), (F.col("range")[0] + 1).cast("long").alias("line_number"), (end + 1).cast("long").alias("end_line"), "seq")
    out = out.where("label is not null and name <> ''")
    return out.select(uid(F.col("name"), F.col("path"), F.col("line_number")).alias("uid"), "*")


def definitions(found: DataFrame) -> DataFrame:
    """symbol -> path, the first, also under the symbol without its version."""
    rows = found.where("(roles & 1) = 1 and not startswith(symbol, 'local ')").select("symbol", F.col("doc").alias("path"), "seq")
    bare = rows.withColumn("symbol", unversioned(F.col("symbol")))
    return rows.unionByName(bare).groupBy("symbol").agg(F.min_by("path", F.struct("seq", "path")).alias("path"))


def unversioned(symbol: Column) -> Column:
    """Scheme, manager and package, then a dot for the version."""
    return F.regexp_replace(symbol, r"^(\S+ \S+ \S+) \S+ ", "$1 . ")


def calls(found: DataFrame, known: DataFrame, lines: DataFrame) -> DataFrame:
    """source_uid, target_uid, line_number: references to functions before a parenthesis, from the innermost function
    around them. ``lines`` has path, line (from 1), text. A reference to a whole module, as a star import leaves it,
    is to the module's function of the name that stands there."""
    end = F.when(F.size("range") >= 4, F.col("range")[3]).otherwise(F.col("range")[2])
    refs = found.where("(roles & 1) = 0 and not startswith(symbol, 'local ')").select("symbol", F.col("doc").alias("path"), (F.col("range")[0] + 1).cast("long").alias("line"), F.col("range")[1].alias("begin"), end.alias("end"))
    functions = known.where("label = 'Function'")
    targets = functions.groupBy("symbol").agg(F.min_by("uid", "seq").alias("target_uid"))
    by_name = functions.groupBy("name", F.col("path").alias("home")).agg(F.max_by("uid", "seq").alias("target_uid"))
    here = refs.join(lines, ["path", "line"]).where(F.ltrim(F.substring("text", F.col("end") + 1, F.lit(1 << 20))).startswith("("))
    here = here.where(~F.substring("text", F.lit(1), F.col("begin")).contains("#"))
    homes = definitions(found).select("symbol", F.col("path").alias("home"))
    starred = here.where(F.col("symbol").endswith("/")).join(homes, "symbol").withColumn("name", F.trim(F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin"))))
    place = ["path", "line", "target_uid"]
    sites = here.join(targets, "symbol").select(*place).unionByName(starred.join(by_name, ["name", "home"]).select(*place)).distinct()
    spans = known.where("label = 'Function'").select("path", "uid", "line_number", "end_line", "seq")
    inside = innermost(sites, spans, ["path"], "line", "line_number", "end_line")
    return inside.where("found is not null").select(F.col("found.uid").alias("source_uid"), "target_uid", F.col("line").alias("line_number")).where("source_uid <> target_uid").distinct()


def inherits(known: DataFrame, info: DataFrame) -> DataFrame:
    at = known.groupBy("symbol").agg(F.min_by("uid", "seq").alias("uid"))
    pairs = info.select("symbol", F.explode("implements").alias("base"))
    return pairs.join(at.select("symbol", F.col("uid").alias("source_uid")), "symbol").join(at.select(F.col("symbol").alias("base"), F.col("uid").alias("target_uid")), "base").select("source_uid", "target_uid").distinct()


def imports(found: DataFrame, lines: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """src_path, dst_path, line_number: references on lines that import, to what another file defines. ``extra`` adds
    definitions (symbol, path) of other indexes."""
    home = definitions(found).withColumn("far", F.lit(0))
    if extra is not None:
        home = home.unionByName(extra.select("symbol", "path").withColumn("far", F.lit(1)))
    home = home.groupBy("symbol").agg(F.min_by("path", F.struct("far", "path")).alias("dst_path"))
    # import and from at the line's beginning, from before a quoted name, require, a line of an import block
    looks = F.col("text").rlike(r"^\s*(?:import|from)\s|\bfrom\s+['\"]|require\s*\(|^\s*(?:[A-Za-z_]\w*\s+|\.\s+)?[\"`][^\"`]+[\"`]\s*$")
    refs = found.where("(roles & 1) = 0").select("symbol", F.col("doc").alias("path"), (F.col("range")[0] + 1).cast("long").alias("line")).join(lines, ["path", "line"]).where(looks)
    exact = refs.join(home, "symbol", "left")
    loose = exact.withColumn("bare", unversioned(F.col("symbol"))).join(home.select(F.col("symbol").alias("bare"), F.col("dst_path").alias("loose")), "bare", "left")
    out = loose.select(F.col("path").alias("src_path"), F.coalesce("dst_path", "loose").alias("dst_path"), "line").where("dst_path is not null and src_path <> dst_path")
    return out.groupBy("src_path", "dst_path").agg(F.min("line").alias("line_number"))
