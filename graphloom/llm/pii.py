"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what the fixed patterns of four kinds (email, ip, card, phone) find. The two words before a seed are a
lexical pattern. Patterns and the identifier-like tokens they precede (instances) form a graph, which Spark scores
in rounds: a pattern's confidence for a kind is the summed score of its distinct instances of that kind over all of
its distinct instances; an instance's score is one less the product of its patterns' doubts; a seed's is one.
Patterns with enough instances and confidence discover identifiers that no fixed pattern knows.

Regular expressions are written so that each run of text is tried once: possessive, and anchored where a run begins
or where the last match ended, which finds the same leftmost matches in linear time, without deep recursion.

Positions come from splitting: the pieces between matches and the matches alternate, so running lengths give every
start. They are code points, ends exclusive.

Defined results: null text is empty; rows are kept one for one, repeated doc_ids and null doc_ids too (spans are
joined back by doc_id and a hash of the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits joined by single signs, if they have 16 to 19 digits; others could only fail
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
#: Tokens that could be identifiers: 6 signs or more with an @ or at least four digits.
_CANDIDATE = r"(?<![^\s])(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){4})[^\s]{6,}+"

ROUNDS = 3
#: Distinct instances (their scores summed) that a pattern needs, and the confidence.
SUPPORT, CONFIDENCE = 5.0, 0.8
#: Code points before a span that are looked through for its two words; where they do not hold two, all before it.
CONTEXT = 64, 4096
#: Documents with discovered spans up to which these are broadcast back instead of shuffling the documents.
BROADCAST_ROWS = 100_000


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, value>> of all matches."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["piece"])
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["found"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(span))).alias("out"))

    found = F.aggregate(pairs, start, step, lambda a: a["out"])
    return F.when(text.rlike(needs), F.when(F.size(pairs) > 1, found).otherwise(empty)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)

    def add(a: Column, i: Column) -> Column:
        digit = F.substring(d, i, F.lit(1)).cast("int")
        twice = digit * 2
        return a + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    v = span["value"]
    n = F.length(_digits(v))
    if kind == "ip":
        parts = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(F.lpad(p, 3, "0"), F.lit("999")) <= 255))
    if kind == "card":
        return n.between(16, 19) & _luhn(v)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> in the order of kinds, then of starts."""
    text = F.coalesce(text, F.lit(""))

    def of(kind: str) -> Column:
        good = F.filter(_matches(text, _PATTERNS[kind], _NEEDS[kind]), lambda s: _valid(kind, s))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*(of(kind) for kind in KINDS))


def _before(text: Column, start: Column) -> Column:
    """The two words before a position, whole and in lower case, or an empty string."""

    def words(reach: Column) -> Column:
        left = F.substring(text, start - reach + 1, reach)
        return F.filter(F.split(F.lower(left), r"\s+"), lambda w: w != "")

    def two(w: Column) -> Column:
        return F.array_join(F.slice(w, -2, 2), " ")

    every = words(start)
    found = F.when(F.size(every) >= 2, two(every)).otherwise("")
    for reach in reversed(CONTEXT):
        near = words(F.lit(reach))
        # the first of the words may be cut, so there must be a third
        found = F.when(start <= reach, F.when(F.size(every) >= 2, two(every)).otherwise("")).when(F.size(near) >= 3, two(near)).otherwise(found)
    return found


def _rounds(mentions: DataFrame, rounds: int, support: float, confidence: float) -> DataFrame:
    """pattern, kind, confidence: the patterns trusted after ``rounds`` rounds of scoring the graph."""
    graph = mentions.where("pattern <> ''").groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    graph = materialise(graph)
    scores = graph.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
    trusted = None
    for _ in range(rounds):
        sizes = graph.groupBy("pattern").agg(F.count("*").alias("instances"))
        weights = graph.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("weight")).where(F.col("weight") >= support)
        rated = weights.join(sizes, "pattern").withColumn("confidence", F.col("weight") / F.col("instances"))
        trusted = materialise(rated.where(F.col("confidence") >= confidence).select("pattern", "kind", "confidence"))
        if trusted.isEmpty():
            break
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        found = graph.where("kind is null").select("pattern", "value").join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        seeds = graph.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
        scores = materialise(seeds.unionByName(found.where(F.col("score") >= confidence)))
    return trusted


def personal_data(docs: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Every row of ``docs`` as doc_id, text_key (hash of the text), base and spans (base and discovered).

    Texts are read once; only spans and their contexts are written and shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"), base_spans(F.col("text")).alias("base"))
    tokens = _matches(F.col("text"), _CANDIDATE, "[0-9@]")
    free = F.filter(tokens, lambda t: ~F.exists(F.col("base"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    mention = lambda kind, s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _before(F.col("text"), s["start"]).alias("pattern"))
    both = F.concat(F.transform("base", lambda s: mention(s["kind"], s)), F.transform(free, lambda s: mention(F.lit(None).cast("string"), s)))
    held = materialise(known.select("doc_id", "text_key", "base", both.alias("mentions")))
    mentions = held.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    trusted = _rounds(mentions, rounds, support, confidence)
    kind = "struct<kind:string,start:int,end:int,value:string>"
    new = mentions.where("kind is null and pattern <> ''").drop("kind").join(trusted, "pattern")
    new = new.groupBy("doc_id", "text_key", "start", "end", "value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    new = materialise(new.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("found")))
    small = new.count() <= BROADCAST_ROWS
    joined = held.select("doc_id", "text_key", "base").alias("h").join(F.broadcast(new) if small else new, ["doc_id", "text_key"], "left")
    rank = lambda s: F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(F.concat("base", F.coalesce("found", F.expr(f"cast(array() as array<{kind}>)"))), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return joined.select("doc_id", "text_key", "base", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by its kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        label = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        grown = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(piece, label))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), grown.alias("out"))

    done = F.aggregate(ordered, begin, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all other columns stay."""
    found = personal_data(docs).where(F.size("spans") > 0)
    found = materialise(found.groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans")))
    small = found.count() <= BROADCAST_ROWS
    left, key = docs.alias("d"), F.xxhash64(F.coalesce(F.col("d.text"), F.lit("")))
    right = (F.broadcast(found) if small else found).alias("f")
    joined = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (key == F.col("f.text_key")), "left")
    text = F.when(F.col("f.spans").isNotNull(), redacted(F.col("d.text"), F.col("f.spans"))).otherwise(F.col("d.text"))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`personal_data` over ``documents``; the counts are of base spans."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
