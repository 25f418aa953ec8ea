"""Cost-balanced packing of tokenised documents into sequences of fixed capacity.

A text becomes token ids and one end id. Inside a task, documents are taken in groups of about
``group_tokens`` ids. Whole sequences are cut off documents longer than the capacity. The rest go, in
descending length, to the sequence of lowest estimated attention cost (linear plus quadratic in
the lengths of its pieces) with remaining room: whole if one of the few cheapest has room for it,
else cut at the end of the cheapest. The number of sequences of a group is the smallest that holds
its ids, so padding stays below one sequence a group.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tagloom.llm.common import batch, map_arrow, texts

END_ID = 1
#: So many of the cheapest sequences are asked whether a piece fits whole.
LOOK = 8
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, cost double"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in "doc_id start length ids_crc32 doc_tokens sequence_id offset sequence_tokens".split()]
    + [("cost", pa.float64())]
)


class WordwiseEncoder:
    """Encodes texts as little-endian 32-bit ids, each distinct word once, with a bounded memory.

    The vocabulary's rule for splitting never joins what stands on both sides of a single space
    between two characters that are not white space, so words (with the space before them) are
    encoded apart and joined. Texts with any other white space around a space are encoded whole.
    """

    BETWEEN = "\t"

    def __init__(self, path: str, remembered: int = 1_000_000):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # A byte-level vocabulary writes bytes that do not print as the characters from 256 on.
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printing}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in byte_of)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.between = self.bpe.encode_ordinary(self.BETWEEN)[0]
        self.remembered, self.known = remembered, {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode(text, allowed_special="all", disallowed_special=()), "<u4")

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.remembered:
            self.known.clear()
        joined = [w for w in words if self.BETWEEN not in w]
        ids = self._ids(self.BETWEEN.join([" " + w for w in joined]))
        cuts = np.flatnonzero(ids == self.between)
        raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        at = 0
        for w, end in zip(joined, ends):
            self.known[w] = raw[at:end]
            at = end + 4
        self.known.update((w, self._ids(" " + w).tobytes()) for w in words if self.BETWEEN in w)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self.known
        if new := [w for w in words if w not in known and _plain(w)]:
            self._learn(new)
            if len(known) == len(new):  # the memory was cleared
                self._learn([w for w in words if w not in known and _plain(w)])
        blobs = list(map(known.get, words))
        odd = np.array([k for k, x in enumerate(blobs) if x is None], np.int64)
        for k in odd.tolist():
            blobs[k] = b""
        plain = np.ones(len(words), bool)
        plain[odd] = False
        size = np.fromiter(map(len, blobs), np.int64, len(words)) // 4
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(blobs), "<u4")
        bounds = split.offsets.to_numpy()
        out = []
        for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
            c = code[a:b]
            if not plain[c].all():
                out.append(self._ids(t))
                continue
            n = size[c[1:]]
            ends = np.cumsum(n)
            at = np.repeat(begin[c[1:]] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            out.append(np.concatenate([self._ids(words[c[0]]), ids[at]]))
        return out


def _plain(word: str) -> bool:
    """Whether a word neither starts nor ends with white space nor is empty."""
    return word != "" and not word[0].isspace() and not word[-1].isspace()


def pack(lengths: Iterable[int], capacity: int, linear: float, quadratic: float) -> list[tuple]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    pieces, rest, used = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, used, 0))
            used += 1
        if n % capacity:
            rest.append((n % capacity, -doc, whole * capacity))
    rest.sort(reverse=True)
    count = -(-sum(r[0] for r in rest) // capacity)
    room = [capacity] * count
    cheapest = [(0.0, k) for k in range(count)]  # a heap of (cost, sequence); full sequences leave it
    for n, doc, start in rest:
        while n:
            passed = []
            while cheapest and len(passed) < LOOK and room[cheapest[0][1]] < n:
                passed.append(heapq.heappop(cheapest))
            if passed and (not cheapest or room[cheapest[0][1]] < n):  # no whole fit among them: cut
                passed.sort(reverse=True)
                heapq.heappush(cheapest, passed.pop())
            cost, k = heapq.heappop(cheapest)
            m = min(n, room[k])
            pieces.append((-doc, start, m, used + k, capacity - room[k]))
            room[k] -= m
            n, start = n - m, start + m
            if room[k]:
                heapq.heappush(cheapest, (cost + linear * m + quadratic * m * m, k))
            for x in passed:
                heapq.heappush(cheapest, x)
    return pieces


def _packer(path, capacity, group_tokens, linear, quadratic):
    encoder, end = WordwiseEncoder(path), np.array([END_ID], "<u4")

    def flush(ids, blobs, base, first):
        lengths = [len(b) for b in blobs]
        pieces = pack(lengths, capacity, linear, quadratic)
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces))
        views = [memoryview(b) for b in blobs]
        crc = [zlib.crc32(views[d][s : s + n]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
        n_seq = int(seq.max()) + 1
        filled = np.bincount(seq, length, n_seq).astype(np.int64)
        piece_cost = linear * length + quadratic * length.astype(float) ** 2
        cost = np.bincount(seq, piece_cost, n_seq)
        own = np.array(lengths, np.int64)
        out = batch(
            _ARROW, doc_id=[ids[d] for d in doc.tolist()], start=start, length=length, ids_crc32=crc, doc_tokens=own[doc],
            sequence_id=base + first + seq, offset=offset, sequence_tokens=filled[seq], cost=cost[seq],
        )
        return out, first + n_seq

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        ids, blobs, held, first = [], [], 0, 0
        for b in batches:
            raw, names = b.column(1).to_pylist(), b.column(0).to_pylist()
            for at in range(0, len(raw), 1000):
                for i, blob in zip(names[at : at + 1000], encoder.encode(raw[at : at + 1000])):
                    ids.append(i), blobs.append(np.append(blob, end))
                    held += len(blob) + 1
                    if held >= group_tokens:
                        out, first = flush(ids, blobs, base, first)
                        yield out
                        ids, blobs, held = [], [], 0
        if ids:
            yield flush(ids, blobs, base, first)[0]

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    group_tokens: int = 2_000_000,
    linear: float = 6144.0,
    quadratic: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Also ``sequence_tokens`` (ids in the sequence) and ``cost`` (the estimated attention cost
    ``linear * n + quadratic * n * n`` summed over its pieces). Nothing is shuffled: a group is a run
    of documents in one task, and a task's number is the upper part of its sequence ids. A group
    holds ``group_tokens`` ids and at most one document more.

    A null or empty text is the end id alone. Repeated rows are packed each for itself. Equal
    lengths keep the order of reading. Text that looks like a special token is read as the
    vocabulary reads it. An empty table gives no rows. Other columns are not read. ``docs`` must
    be deterministic, as Spark may run a task again.
    """
    read = texts(docs, id_col, text_col)
    return map_arrow(read, lambda: _packer(tokenizer_path, capacity, group_tokens, linear, quadratic), SCHEMA)
