"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from a bounded sample of labelled training texts. Every text is compressed in
pieces of ``PIECE`` bytes with either dictionary, so that the dictionaries count as much at the end of a
long text as at its beginning. The difference of the compressed sizes over the size of the text,
calibrated by a logistic fit on other labelled training texts, is the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.common import batch, labelled_sample, map_arrow, texts

PIECE = 2048
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, bits_good double, bits_bad double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    + [("bits_good", pa.float64()), ("bits_bad", pa.float64())]
)


@dataclass(frozen=True)
class CompressionModel:
    """The dictionaries, the compression level, and the calibration (weights, centre, scale)."""

    good: bytes
    bad: bytes
    level: int = 3
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    centre: tuple[float, ...] = (0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: CompressionModel):
        self.model = model
        self.compress = []
        for content in (model.good, model.bad):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=model.level)
            c = zstandard.ZstdCompressor(
                level=model.level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            self.compress.append(c.compress)

    def features(self, text: str) -> tuple[float, float, float]:
        """Compressed bits a byte with either dictionary, and their difference (bad less good)."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0, 0.0
        pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
        good, bad = (8 * sum(len(c(p)) for p in pieces) / len(raw) for c in self.compress)
        return good, bad, bad - good

    def score(self, features: tuple[float, float, float]) -> float:
        m = self.model
        z = m.weights[0] + sum(w * (x - c) / s for w, x, c, s in zip(m.weights[1:], features, m.centre, m.scale))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _content(sample: list[str], size: int) -> bytes:
    """A dictionary of ``size`` bytes at most: an even share of every text, the pieces spread over it."""
    if not sample:
        return b""
    share, raw = max(64, size // len(sample)), bytearray()
    for text in sample:
        t = text.encode("utf-8", "surrogatepass")
        for k in range(4):
            at = k * max(0, len(t) - share // 4) // 3
            raw += t[at : at + share // 4]
    return bytes(raw[-size:])


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, per_class: int = 1500, dictionary_bytes: int = 112_640, level: int = 3
) -> CompressionModel:
    """Fits on at most ``per_class`` whole texts of each label, chosen by a hash of the id.

    Half of the sample of each class makes its dictionary, the other half the calibration, weighted
    back to the share the classes have among all training labels. Without texts of both
    classes every text scores the share of label 1 (0.5 without labels).
    """
    sample = labelled_sample(docs, labels, "quality", training, per_class).select("doc_id", "text", "y").collect()
    sample.sort(key=lambda r: r.doc_id)
    counts = {r.quality: r["count"] for r in labels.where(training).groupBy("quality").count().collect()}
    part = {y: [r.text for r in sample if r.y == y] for y in (0, 1)}
    known = counts.get(0, 0) + counts.get(1, 0)
    if len(part[0]) < 2 or len(part[1]) < 2:
        share = min(max(counts.get(1, 0) / known, 1e-3), 1 - 1e-3) if known else 0.5
        return CompressionModel(b"", b"", level, (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    good, bad = (_content(part[y][::2], dictionary_bytes) for y in (1, 0))
    scorer = CompressionModel(good, bad, level).scorer()
    x = np.array([scorer.features(t) for y in (0, 1) for t in part[y][1::2]])
    y = np.repeat([0.0, 1.0], [len(part[k][1::2]) for k in (0, 1)])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - centre) / scale, y)
    # The sample holds the classes in other shares than the labels do.
    w[0] += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return CompressionModel(good, bad, level, tuple(w), tuple(centre), tuple(scale))


def score(docs: DataFrame, model: CompressionModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, bits a byte with either dictionary.

    Empty and null texts have no bytes and score as the calibration of zeros gives; a repeated row
    gives a row each; an empty table none; other columns are not read. The model is broadcast: its
    size is twice ``dictionary_bytes`` at most. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()

        def run(batches):
            for b in batches:
                found = [scorer.features(t) for t in b.column(1).to_pylist()]
                scores = [scorer.score(x) for x in found]
                yield batch(
                    _ARROW, doc_id=b.column(0), held_out=b.column(2), score=scores, predicted=[int(s >= 0.5) for s in scores],
                    bits_good=[x[0] for x in found], bits_bad=[x[1] for x in found],
                )

        return run

    return map_arrow(texts(docs, id_col, text_col).select("doc_id", "text", held_out.alias("held_out")), make, SCHEMA)
