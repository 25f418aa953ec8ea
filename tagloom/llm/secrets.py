"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From each rule's pattern the trigrams that every match must contain are derived, as alternatives of sets.
The index lists which documents hold which of these trigrams; a rule's candidates are the documents
whose postings contain one of its sets whole. Candidates are verified with the pattern itself.
A rule without mandatory trigrams scans all documents.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import texts


@dataclass(frozen=True)
class Rule:
    """A named pattern; a match counts if its ``group`` has at least ``least`` characters.

    ``quick`` may name a cheaper pattern that a text with a counting match must contain.
    """

    name: str
    pattern: str
    group: int
    least: int
    quick: str | None = None


BASE_RULES = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 and more: a greedy leftmost match is a whole run, so shorter runs need not be listed.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
]
ADDED_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
]
MOST_ALTERNATIVES = 64
#: Elements summed in one piece: an array's length times this many are copied.
PIECE = 256


def mandatory_trigrams(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigram sets, one of which every match contains whole.

    None if some way to match needs no trigram.
    """
    ways = _literals(regex_parser.parse(pattern), [((), "")])
    sets = [
        frozenset(run[k : k + 3].lower() for run in (*done, last) for k in range(len(run) - 2)) for done, last in ways
    ]
    if not all(sets):
        return None
    return sorted({s for s in sets if not any(t < s for t in sets)}, key=sorted)


def _literals(tokens, ways):
    """Extends ways (finished literal runs, running literal) over a parsed pattern."""

    def broken(some):
        return list(dict.fromkeys(((*done, last) if len(last) > 2 else done, "") for done, last in some))

    for op, value in tokens:
        name = str(op)
        if name == "LITERAL":
            ways = [(done, last + chr(value)) for done, last in ways]
        elif name == "SUBPATTERN":
            ways = _literals(value[-1], ways)
        elif name == "BRANCH":
            ways = [w for branch in value[1] for w in _literals(branch, ways)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            if (least, most) == (0, 1):
                ways = ways + _literals(inner, ways)
            else:
                ways = broken(_literals(inner, ways) if least else ways)
        elif name != "AT":
            ways = broken(ways)
        if len(ways) > MOST_ALTERNATIVES:
            ways = [((), "")]
    return ways


def build_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings (trigram, doc_id) of the given lower-case trigrams, one row for each holder row."""
    low = texts(docs, id_col, text_col).select("doc_id", F.lower("text").alias("low"))
    held = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]
    if not held:
        return low.select(F.lit("").alias("trigram"), "doc_id").limit(0)
    return low.select(F.explode(F.array_compact(F.array(*held))).alias("trigram"), "doc_id")


def _intersected(index: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """doc_id and one flag for each rule: its postings hold one of the rule's sets whole."""
    words = range(0, len(trigrams), 60)
    spot = {t: k for k, t in enumerate(trigrams)}
    bits = [
        F.bit_or(F.coalesce(*[F.when(F.col("trigram") == t, F.lit(1 << (spot[t] - w))) for t in trigrams[w : w + 60]], F.lit(0))).alias(f"w{w}")
        for w in words
    ]

    def whole(one: frozenset[str]) -> Column:
        flag = F.lit(True)
        for w in words:
            mask = sum(1 << (spot[t] - w) for t in one if w <= spot[t] < w + 60)
            if mask:
                flag = flag & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == mask)
        return flag

    flags = []
    for name, alternatives in queries.items():
        flag = F.lit(False)
        for one in alternatives:
            flag = flag | whole(one)
        flags.append(flag.alias(f"may_{name}"))
    return index.groupBy("doc_id").agg(*bits).select("doc_id", *flags)


def _sums(numbers: Column) -> Column:
    """The sums of an array's first 1, 2, ... elements, taken in pieces of ``PIECE`` so that long arrays stay cheap.

    Appending to an array copies it; only arrays of a piece's length, or one element a piece, are appended to.
    """
    none = F.array().cast("array<bigint>")

    def running(some: Column, begin: Column) -> Column:
        def step(done, x):
            now = done["at"] + x
            return F.struct(now.alias("at"), F.concat(done["sums"], F.array(now)).alias("sums"))

        return F.aggregate(some, F.struct(begin.alias("at"), none.alias("sums")), step, lambda done: done["sums"])

    zero = F.lit(0).cast("long")
    firsts = F.sequence(F.lit(0), F.greatest(F.size(numbers) - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(firsts, lambda at: F.slice(numbers, at + 1, PIECE))
    totals = F.transform(pieces, lambda some: F.aggregate(some, zero, lambda x, y: x + y))
    before = F.concat(F.array(zero), running(totals, zero))
    return F.flatten(F.zip_with(pieces, F.slice(before, 1, F.size(pieces)), running))


def _spans(rule: Rule, number: int) -> Column:
    """The counting matches of a rule as (start, number, end), from the columns that ``_matches`` made."""
    span = "struct<start:bigint,kind:int,end:bigint>"
    found, counts, ends = (F.col(f"{c}_{rule.name}") for c in ("found", "counts", "ends"))

    def one(found, counts, end):
        start = end - F.length(found)
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), F.length(counts).alias("counts"))

    rows = F.transform(F.arrays_zip(found.alias("f"), counts.alias("c"), ends.alias("e")), lambda m: one(m["f"], m["c"], m["e"]))
    spans = F.transform(F.filter(rows, lambda m: m["counts"] >= rule.least), lambda m: F.struct(m["start"], m["kind"], m["end"]).cast(span))
    return F.coalesce(spans, F.array().cast(f"array<{span}>"))


def _matches(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds, for each rule and candidate, its matches, the groups that count and where the matches end.

    Gaps and matches alternate in a text, so a match ends at the sum of the lengths up to it.
    """
    text = F.col("text")
    for columns in (
        lambda r: {
            f"found_{r.name}": F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)),
            f"counts_{r.name}": F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)),
            f"gaps_{r.name}": F.split(text, r.pattern, -1),
        },
        lambda r: {
            f"lengths_{r.name}": F.zip_with(
                F.col(f"found_{r.name}"), F.slice(F.col(f"gaps_{r.name}"), 1, F.size(f"found_{r.name}")),
                lambda m, gap: (F.length(m) + F.length(gap)).cast("long"),
            )
        },
        lambda r: {f"ends_{r.name}": _sums(F.col(f"lengths_{r.name}"))},
    ):
        made = {}
        for r in rules:
            may = F.col(f"may_{r.name}")
            made |= {k: F.when(may, v) for k, v in columns(r).items()}
        found = found.withColumns(made)
    return found


def find_secrets(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    base: int = 3,
    index: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, n_<rule>, base_sha256 and spans.

    ``spans`` lists rule:start:end (code points, end exclusive) by start, then by the order of the
    rules; the hash covers the first ``base`` rules. ``index`` may be a stored ``build_index``
    of the same documents with the rules' trigrams.

    Null or empty texts have no spans. Repeated rows give a row each; rows that share an id share
    postings, which only adds candidates. Null ids are kept. An empty table gives no rows; other
    columns are not read. The join is on the document id and carries every text once.
    """
    rules = rules or BASE_RULES + ADDED_RULES
    queries = {r.name: q for r in rules if (q := mandatory_trigrams(r.pattern)) is not None}
    trigrams = sorted(set().union(*(one for q in queries.values() for one in q)))
    read = texts(docs, id_col, text_col)
    if index is None:
        index = build_index(read, trigrams)
    may = _intersected(index, queries, trigrams).withColumnRenamed("doc_id", "found_id") if trigrams else None
    if may is not None:
        read = read.join(may, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    flags = {
        f"may_{r.name}": F.coalesce(F.col(f"may_{r.name}"), F.lit(False)) if r.name in queries else F.lit(True)
        for r in rules
    }
    found = read.select("doc_id", "text", *[(v & F.col("text").rlike(r.quick or r.pattern)).alias(f"may_{r.name}") for r, v in zip(rules, flags.values())])
    found = _matches(found, rules).select("doc_id", *[_spans(r, k).alias(f"s_{r.name}") for k, r in enumerate(rules)])
    names = F.array(*[F.lit(r.name) for r in rules])

    def written(some: list[Rule]) -> Column:
        every = F.array_sort(F.concat(*[F.col(f"s_{r.name}") for r in some]))
        return F.array_join(
            F.transform(
                every,
                lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    return found.select(
        "doc_id",
        *[F.size(f"s_{r.name}").cast("long").alias(f"n_{r.name}") for r in rules],
        F.sha2(written(rules[:base]), 256).alias("base_sha256"),
        written(rules).alias("spans"),
    )
