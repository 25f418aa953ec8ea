"""What the operators of this folder share: reading, Arrow mapping, labelled samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty.

    Other columns, whatever their names, stay out of the scan and cannot clash.
    """
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def release() -> None:
    """Gives freed memory back to the system: a worker stays for later tasks and should not hold what it no longer needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[Iterator], Iterator]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds a task's state once and returns its batch function."""

    def run(batches):
        try:
            yield from make()(b for b in batches if b.num_rows)
        finally:
            release()

    return df.mapInArrow(run, schema)


def where_text(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text passes the test that ``make()`` builds in a task.

    The test gets the texts of up to a thousand rows (null as empty). Nothing is shuffled.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        passes = make()
        for big in batches:
            for first in range(0, big.num_rows, 1000):
                b = big.slice(first, 1000)
                yield b.filter(pa.array(passes([t or "" for t in b.column(at).to_pylist()]), pa.bool_()))
        del passes
        release()

    return docs.mapInArrow(run, docs.schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def remainder(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; the fixed rule that deals rows to folds."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int | tuple[int, int], max_chars: int = 100_000
) -> DataFrame:
    """At most ``per_class`` whole labelled texts of each class (or of classes 0 and 1), chosen by a hash of the id.

    ``training`` is a condition on ``doc_id``. The chosen ids are
    broadcast, so the texts are scanned once and not shuffled. Empty texts and texts over
    ``max_chars`` are left out, which bounds what a fit holds to 2 * per_class * max_chars
    characters. Returns doc_id, text, y (0/1).
    """
    known = (
        labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & training)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    ids = None
    sizes = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(*order).limit(sizes[y])
        ids = part if ids is None else ids.unionAll(part)
    ids = ids.collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.y) for r in ids], known.schema)
    return (
        texts(docs)
        .where(F.length("text").between(1, max_chars))
        .join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"])
    )


@contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings (dots as double underscores) for the jobs run inside the block."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
