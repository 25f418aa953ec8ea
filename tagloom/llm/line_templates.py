"""Line dedup with a log-template tree.

A line of n tokens stands below the node of its token count and its leading tokens. Tokens with a
digit are variable fields. Below that, a line matches a template if all its tokens outside one run of
a fifth of the tokens agree (so at least 0.8 of them): each line gives one template for itself and one for each place of
that field. The places start at the fourth token and do not overlap: lines that differ in a run across the border of two
places, or in scattered tokens, are not matched. A template is known by a hash, and its first document by a minimum, so neither lines nor
pairs of lines are gathered. A line is dropped when one of its templates occurs in an earlier
document; the first document keeps it.

``careful`` (the pipeline) wants constant tokens in a template: at least half of the line's tokens and three
stand outside its fields. Other lines, as the rows of a numeric table, are compared token by token. The SQL twin
of ``op1`` has no such rule and masks them, so that query does too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import batch, map_arrow, texts
from tagloom.llm.hashing import WordHasher, joined, mix, parts

DEPTH = 3
#: Shorter lines have no template and stay.
MIN_TOKENS = 4
#: Tokens that a careful template must have outside its fields, besides half of all.
LEAST_CONSTANT = 3
#: The hash of a variable field.
FIELD = np.uint64(0x27D4EB2F165667C5)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


def line_tokens(hasher: WordHasher, texts: list[str], min_tokens: int):
    """(hashes, has a digit, sizes, texts, numbers) of the lines with at least ``min_tokens`` tokens."""
    raw, ends = joined(texts)
    hashes, start, end = hasher(raw)
    digits = np.concatenate([np.zeros(1, np.int32), np.cumsum(_DIGIT[raw], dtype=np.int32)])
    variable = digits[end] > digits[start]
    feeds = np.flatnonzero(raw == 10)
    line = np.searchsorted(feeds, start)
    sizes = np.bincount(line, minlength=len(feeds))
    text = np.searchsorted(ends, feeds, side="right")
    number = np.arange(len(feeds)) - np.searchsorted(feeds, ends - np.diff(ends, prepend=0))[text]
    keep = sizes >= min_tokens
    kept = keep[line]
    return hashes[kept], variable[kept], sizes[keep], text[keep], number[keep]


def _templates(hashes: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(line, key, first and last token of the hidden run) of every template of lines given as joined token hashes."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(hashes)) - np.repeat(first, sizes)
    placed = mix(hashes + (place.astype(np.uint64) + np.uint64(1)) * _M2)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed, dtype=np.uint64)])
    whole = sums[first + sizes] - sums[first] + mix(sizes.astype(np.uint64))
    width = sizes // 5
    fields = np.where(width > 0, -(-(sizes - depth) // np.maximum(width, 1)), 0)
    line = np.repeat(np.arange(len(sizes)), fields)
    number = np.arange(len(line)) - np.repeat(np.cumsum(fields) - fields, fields)
    start = depth + number * width[line]
    end = np.minimum(start + width[line], sizes[line])
    hidden = sums[first[line] + end] - sums[first[line] + start]
    with_field = mix(whole[line] - hidden + (number.astype(np.uint64) + np.uint64(1)) * _M1)
    lines, keys = np.concatenate([np.arange(len(sizes)), line]), np.concatenate([mix(whole), with_field])
    return lines, keys, np.concatenate([first, first[line] + start]), np.concatenate([first, first[line] + end])


def template_keys(hashes: np.ndarray, variable: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every template, with every token that has a digit as a field."""
    line, key, _, _ = _templates(np.where(variable, FIELD, hashes), sizes, depth)
    return line, key.view(np.int64)


def careful_keys(hashes: np.ndarray, variable: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the templates with enough constant tokens, of the same by literal tokens, and of other lines literally.

    A key is odd if it says that all tokens outside the hidden run are equal.
    """
    line, key, low, high = _templates(np.where(variable, FIELD, hashes), sizes, depth)
    _, literal, _, _ = _templates(hashes, sizes, depth)
    seen, first = np.concatenate([np.zeros(1, np.int64), np.cumsum(variable)]), np.cumsum(sizes) - sizes
    fields = (seen[first + sizes] - seen[first])[line] - (seen[high] - seen[low])
    constant, size = sizes[line] - (high - low) - fields, sizes[line]
    enough = (constant >= LEAST_CONSTANT) & (2 * constant >= size)
    masked, equal = enough & (fields > 0), np.where(enough, True, low == high)
    keys = np.concatenate([key[masked] & ~np.uint64(1), literal[equal] | np.uint64(1)])
    return np.concatenate([line[masked], line[equal]]), keys.view(np.int64)


def _keys(depth: int, min_tokens: int, careful: bool):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        hasher = WordHasher(lower=False)
        for b in batches:
            ids, raw = b.column(0), b.column(1).to_pylist()
            for part in parts(raw):
                hashes, variable, sizes, text, number = line_tokens(hasher, raw[part], min_tokens)
                if len(sizes):
                    line, key = (careful_keys if careful else template_keys)(hashes, variable, sizes, depth)
                    owner = ids.take(pa.array(part.start + text[line]))
                    yield batch(schema, key=key, doc_id=owner, pos=number[line].astype(np.int32))

    return run


def repeated_lines(
    docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, id_col: str = "doc_id", text_col: str = "text",
    careful: bool = False,
) -> DataFrame:
    """doc_id and ``dropped``, the numbers (from 0) of its lines whose template an earlier document has.

    With ``careful`` also ``copied``, those of them that equal an earlier line by literal tokens outside one run.

    Earlier is by the id; rows that share an id are one document; a null id comes after all others.
    Lines of fewer than ``min_tokens`` tokens have no template. Only hashes and ids are shuffled. The first
    documents are a minimum, combined before the shuffle; the join splits hot templates
    through the adaptive planner, as either side may be read in parts.
    """
    keys = map_arrow(texts(docs, id_col, text_col), lambda: _keys(depth, min_tokens, careful), "key long, doc_id long, pos int")
    last = F.lit((1 << 63) - 1)
    keys = keys.withColumn("order", F.coalesce("doc_id", last))
    first = keys.groupBy("key").agg(F.min("order").alias("first"), F.max("order").alias("latest")).where("first < latest")
    repeats = keys.join(first.select("key", "first"), "key").where("order > first")
    found = [F.collect_set("pos").alias("dropped")]
    if careful:
        found.append(F.collect_set(F.when(F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1, F.col("pos"))).alias("copied"))
    return repeats.groupBy("doc_id").agg(*found)


def drop_lines(
    docs: DataFrame, repeats: DataFrame, drop_emptied: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the same columns, its texts without the dropped lines. A null text stays null.

    ``drop_emptied`` leaves out the documents that lose lines and keep no word. If ``repeats`` has ``copied``, such
    a document loses only the copied lines, and goes if it keeps no word then: all it held stands, but for
    a fifth of a line, in earlier documents.
    """
    fields = docs.schema
    copied = F.col("copied" if "copied" in repeats.columns else "dropped").alias("__copied")
    drops = repeats.select(F.col("doc_id").alias("__id"), F.col("dropped").alias("__dropped"), copied)
    joined = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left").drop("__id")
    names = [f.name for f in fields]
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            drop, raw = b.column(len(names)).to_pylist(), b.column(at).to_pylist()
            kept = [t if t is None or not d else _kept(t, d)[0] for t, d in zip(raw, drop)]
            if drop_emptied:
                copies = b.column(len(names) + 1).to_pylist()
                kept = [_kept(t, c)[0] if t and d and not k.split() else k for k, t, d, c in zip(kept, raw, drop, copies)]
            columns = [pa.array(kept, b.column(k).type) if k == at else b.column(k) for k in range(len(names))]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            if drop_emptied:
                out = out.filter(pa.array([not d or bool(t and t.split()) for t, d in zip(kept, drop)], pa.bool_()))
            yield out

    return joined.mapInArrow(run, fields)


def _kept(text: str, dropped: list[int]) -> tuple[str, int]:
    lines, out = text.split("\n"), set(dropped)
    return "\n".join(x for k, x in enumerate(lines) if k not in out), len(lines)


def line_report(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_lines, n_dropped, kept_sha256 (of the text that stays)."""
    read = texts(docs, id_col, text_col)
    drops = repeats.select(F.col("doc_id").alias("__id"), "dropped")
    joined = read.join(drops, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "dropped")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            drop = [d or [] for d in b.column(2).to_pylist()]
            kept = [_kept(t, d) for t, d in zip(b.column(1).to_pylist(), drop)]
            sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _ in kept]
            yield batch(schema, doc_id=b.column(0), n_lines=[n for _, n in kept], n_dropped=[len(d) for d in drop], kept_sha256=sha)

    return map_arrow(joined, lambda: run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
masked AS (
  SELECT doc_id, pos, list_transform(
      list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
      lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM split),
sized AS (SELECT *, len(t) AS n, len(t) // 5 AS w FROM masked WHERE len(t) >= 4),
keys AS (
  SELECT doc_id, pos, n, -1 AS b, t AS a, t[1:0] AS z FROM sized
  UNION ALL
  SELECT doc_id, pos, n, b, t[1:3 + b * w] AS a, t[3 + (b + 1) * w + 1:] AS z
  FROM (SELECT *, unnest(range(0, (n - 3 + w - 1) // w)) AS b FROM sized WHERE w > 0)),
firsts AS (SELECT n, b, a, z, min(doc_id) AS first FROM keys GROUP BY n, b, a, z),
dropped AS (
  SELECT DISTINCT doc_id, pos FROM keys JOIN firsts USING (n, b, a, z) WHERE first < doc_id)
SELECT s.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped,
  sha256(coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (WHERE d.pos IS NULL), '')) AS kept_sha256
FROM split s LEFT JOIN dropped d ON s.doc_id = d.doc_id AND s.pos = d.pos
GROUP BY s.doc_id"""
