"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four kinds have a base rule: a regular expression and a test of each match. Its matches are the seeds. Every
identifier-like stretch of the corpus is a mention: a token with digits or an at sign, or groups of digits with spaces, dots,
brackets or hyphens between them. A mention has five lexical patterns: its shape after the word on its left, its
shape before the word on its right, the word on its left alone, the two words on its left, and the words on both sides.
The last three know no shape, so that they lead to identifiers written as no seed is.

Patterns and the values found with them are a graph. In turns, a pattern's confidence in a kind is the mean score of its
values, and a value that is no seed takes the greatest confidence of its well-supported patterns, among the
kinds that its characters allow. The next turn counts it for its other patterns. Values that end above ``accept`` are new
identifiers wherever they are mentioned.

The expressions below match what the plain ones match, but with possessive parts, and begin only where a run begins
or the last match ended: so they take linear time and no deep recursion on any text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import cut, texts
from pathloom.plans.lineage import unbound

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
MENTION = r"(?<![A-Za-z0-9@._%+-])(?:[+(]{0,2}+[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++(?![A-Za-z0-9@_%+])|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{6,}+)"
#: What a value must look like to be discovered as a kind: an address around an at sign, four numbers, or digits alone.
PLAUSIBLE = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[^0-9A-Za-z]*[0-9]){12,19}[^0-9A-Za-z]*$",
    "phone": r"^(?:[^0-9A-Za-z]*[0-9]){7,15}[^0-9A-Za-z]*$",
}
MENTIONED = "struct<start:int,end:int,value:string,left:string,left2:string,right:string>"
SPAN = "struct<start:int,kind:int,end:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    """Prefix sums of an array of integers, by doubling: linear for each of at most 27 passes, none for a single value."""

    def add(sums: Column, step: int) -> Column:
        return let(sums, lambda s: F.when(F.size(s) > step, F.transform(s, lambda x, i: x + F.when(i >= step, F.get(s, i - step)).otherwise(0))).otherwise(s))

    return reduce(add, [1 << k for k in range(27)], values)


def matches(text: Column, pattern: str, make: Callable[[Column, Column, Column, Column], Column], empty: str) -> Column:
    """make(value, end, pieces, i) of each match of a text that has any; pieces are what lies between the matches."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.expr(f"cast(array() AS array<{empty}>)")).otherwise(
        let(F.split(text, pattern, -1), lambda pieces: let(running(F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))),
                                                           lambda ends: F.transform(found, lambda m, i: make(m, F.get(ends, i), pieces, i))))))


def luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match passes its kind's test."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(f"^{PART}(?:\\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of all kinds, in code points, by start, then kind."""
    return F.sort_array(F.concat(*(_kind_spans(text, number, kind) for number, kind in enumerate(KINDS))))


def _kind_spans(text: Column, number: int, kind: str) -> Column:
    span = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(number).alias("kind"), end.alias("end"))
    found = matches(text, PATTERNS[kind], lambda m, end, pieces, i: F.struct(span(m, end).alias("span"), m.alias("value")), f"struct<span:{SPAN},value:string>")
    return F.filter(found, lambda s: holds(kind, s["value"]))["span"]


def mentions(text: Column) -> Column:
    """Identifier-like stretches: start, end, value, and the words around: left, left2 (before left) and right; empty where there is none."""
    spaces = lambda c: F.translate(c, "\t\n\u000b\f\r\u00a0", "      ")
    bare = lambda word: F.lower(F.trim(word, F.lit(".,:;!?()[]{}<>\"'")))

    def around(m: Column, end: Column, pieces: Column, i: Column) -> Column:
        after = bare(F.substring_index(F.ltrim(spaces(F.get(pieces, i + 1))), " ", 1))
        return let(F.rtrim(spaces(F.get(pieces, i))), lambda before: let(F.substring_index(before, " ", -1), lambda last: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"), bare(last).alias("left"),
            bare(F.substring_index(F.rtrim(F.left(before, F.length(before) - F.length(last))), " ", -1)).alias("left2"), after.alias("right"))))

    return F.filter(matches(text, MENTION, around, MENTIONED), lambda m: F.length(m["value"]) >= 6)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def label(marked: DataFrame) -> DataFrame:
    """Each mention with the kind of a base span that it overlaps (the one that ends last), else null.

    Spans and mentions of a text are swept in one order: a mention is reached after the spans that start before its end.
    """
    spans = marked.select("doc_id", "key", F.explode("base").alias("s")).select("doc_id", "key", F.col("s.start").alias("at"), F.lit(0).alias("late"), F.struct("s.end", "s.kind").alias("span"), F.lit(None).cast(MENTIONED).alias("m"))
    tokens = marked.select("doc_id", "key", F.explode("mentions").alias("m")).select("doc_id", "key", (F.col("m.end") - 1).alias("at"), F.lit(1).alias("late"), F.lit(None).cast("struct<end:int,kind:int>").alias("span"), "m")
    before = Window.partitionBy("doc_id", "key").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    swept = spans.unionByName(tokens).withColumn("last", F.max("span").over(before)).where("m IS NOT NULL")
    return swept.select("doc_id", "key", "m.*", F.when(F.col("last.end") > F.col("m.start"), F.col("last.kind")).alias("kind"))


def patterns() -> Column:
    """The lexical patterns of a mention, as hashes; those that would need a missing word are left out."""
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), "[A-Za-z]+", "a")
    some = lambda name, *parts: F.when(F.length(parts[-1]) > 0, F.xxhash64(F.lit(name), *parts))
    left, left2, right = F.col("left"), F.col("left2"), F.col("right")
    both = F.when(F.length(left) > 0, some("both", left, right))
    return F.array_compact(F.array(F.xxhash64(F.lit("before"), left, shape), F.xxhash64(F.lit("after"), shape, right), some("left", left), some("two", left, left2), both))


def plausible(value: Column, kind: Column) -> Column:
    found = F.lit(False)
    for number, name in enumerate(KINDS):
        found = F.when(kind == number, value.rlike(PLAUSIBLE[name])).otherwise(found)
    return found


def bootstrap(labelled: DataFrame, rounds: int = 3, confident: float = 0.7, support: float = 3.0, accept: float = 0.7) -> DataFrame:
    """value, found (kind) of the values, no seeds themselves, that the patterns of the seeds lead to.

    A value that is mentioned with several kinds takes the first as listed in KINDS, and of equal scores the first kind wins.
    """
    graph = cut(labelled.select(F.explode(patterns()).alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.min("kind").alias("kind")))
    seeds = graph.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("found")).withColumn("score", F.lit(1.0))
    totals = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = seeds
    for _ in range(rounds):
        sums = graph.select("pattern", "value").join(scores, "value").groupBy("pattern", "found").agg(F.sum("score").alias("s"))
        good = sums.join(totals, "pattern").where((F.col("s") >= support) & (F.col("s") >= confident * F.col("n"))).select("pattern", "found", (F.col("s") / F.col("n")).alias("score"))
        reached = graph.select("pattern", "value").join(unbound(good, "pattern"), "pattern").where(plausible(F.col("value"), F.col("found"))).groupBy("value", "found").agg(F.max("score").alias("score"))
        unseen = reached.join(seeds.select("value"), "value", "left_anti").groupBy("value").agg(F.max(F.struct("score", (-F.col("found")).alias("turned"))).alias("best"))
        scores = cut(seeds.unionByName(unseen.select("value", (-F.col("best.turned")).alias("found"), "best.score")))
    return scores.where(F.col("score") >= accept).select("value", "found").join(seeds.select("value"), "value", "left_anti")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, key (a hash of the text), base and spans: the base spans and those with what the patterns discovered, by start, then kind.

    Null texts are empty and have no spans. Rows that repeat id and text get the same spans; null ids equal each other. Context
    words are whole, at any length and distance. An empty table gives no rows.
    """
    docs = texts(docs, id_col, text_col)
    marked = cut(docs.select("doc_id", F.xxhash64("text").alias("key"), base_spans(F.col("text")).alias("base"), mentions(F.col("text")).alias("mentions")))
    labelled = cut(label(marked))
    found = labelled.where("kind IS NULL").join(bootstrap(labelled, **settings), "value")
    per_row = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", F.col("found").alias("kind"), "end")).alias("more"))
    per_row = per_row.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "more")
    joined = marked.join(per_row, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return joined.select("doc_id", "key", "base", F.sort_array(F.concat("base", F.coalesce("more", F.expr(f"cast(array() AS array<{SPAN}>)")))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    joined = F.aggregate(spans, F.expr(f"cast(array() AS array<{SPAN}>)"), lambda done, s: let(F.get(done, F.size(done) - 1), lambda last: F.when(
        F.coalesce(last["end"] > s["start"], F.lit(False)),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(s)))))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def rebuilt(runs: Column) -> Column:
        pieces = F.transform(runs, lambda r, i: let(F.coalesce(F.get(runs, i - 1)["end"], F.lit(0)), lambda start: F.concat(F.substring(text, start + 1, r["start"] - start), F.get(names, r["kind"]))))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.get(runs, F.size(runs) - 1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(joined, rebuilt)).otherwise(text)


def without_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, their private spans replaced by their kind.

    Only texts with spans change; the others, null included, stay as they are. Null ids equal each other; such rows are told apart by their text.
    """
    found = find_private(docs, id_col, text_col).where(F.size("spans") > 0).select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("key")), "left")
    text = F.col("row").getField(text_col)
    hidden = F.when(F.col("spans").isNotNull(), redact(text, F.col("spans"))).otherwise(text)
    return joined.select(*(hidden.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
