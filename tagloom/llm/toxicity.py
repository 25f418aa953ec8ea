"""Toxicity: a lexicon trie walked by Levenshtein automata, weighed by the words around a hit.

The lexicon (whole words, and stems that take any ending) is learned from a bounded sample of labelled
training texts. A deterministic automaton, built state by state as tokens need it, accepts every token
within the allowed edits of an entry. Around each hit a window of words is looked at: quotation marks and
words of reporting speak for a quotation, second persons for abuse. A logistic fit on other
labelled training texts turns the counts into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tagloom.llm.common import batch, labelled_sample, map_arrow, texts, where_text
from tagloom.llm.compression_quality import logistic

SCHEMA = (
    "doc_id long, held_out boolean, score double, predicted int, n_terms long, n_misspelled long, n_quoted long, n_direct long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    + [(n, pa.int64()) for n in ("n_terms", "n_misspelled", "n_quoted", "n_direct")]
)

# Signs of quotation and of address in the four languages.
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote quoted quote called reported sagte schrieb zitat dit écrit cité dijo escribió cita".split())
ADDRESS = frozenset("you your you're du dich dein ihr tu te toi vous ton tú ti usted".split())
WINDOW = 8  # words on either side


def allowed_edits(entry: str) -> int:
    """Edits allowed for an entry; ``*`` at its end marks a stem."""
    if entry.endswith("*"):
        return int(len(entry) > 7)
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


class LexiconAutomaton:
    """The product of a trie with Levenshtein automata, made deterministic on demand."""

    def __init__(self, entries: list[str], most_states: int = 200_000):
        self.children, self.entry, self.budget, self.stem = [{}], [None], [0], [False]
        for e in entries:
            node, edits = 0, allowed_edits(e)
            self.budget[0] = max(self.budget[0], edits)
            for c in e.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.entry.append(None), self.budget.append(0), self.stem.append(False)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], edits)
            self.entry[node], self.stem[node] = e, self.stem[node] or e.endswith("*")
        self.most_states = most_states
        self._reset()

    def _reset(self):
        self.steps, self.sets, self.numbers, self.ends, self.within = [], [], {}, [], []
        self.start = self._state({(0, 0)})

    def _close(self, pairs: set) -> frozenset:
        """Adds the states reached by letters missing from the token; keeps the fewest edits a node."""
        least, todo = {}, list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.budget[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(k, e + 1) for k in self.children[node].values()]
        return frozenset(least.items())

    def _state(self, pairs: set) -> int:
        closed = self._close(pairs)
        if not closed:
            return -1
        if closed not in self.numbers:
            self.numbers[closed] = len(self.sets)
            self.sets.append(closed), self.steps.append({})
            hits = [(e, self.entry[n], self.stem[n]) for n, e in closed if self.entry[n] and e <= allowed_edits(self.entry[n])]
            self.ends.append(min(((e, x) for e, x, _ in hits), default=None))
            self.within.append(min(((e, x) for e, x, stem in hits if stem), default=None))
        return self.numbers[closed]

    def match(self, token: str) -> tuple[int, str] | None:
        """The fewest edits and the entry that accept ``token``, if any."""
        if len(self.sets) > self.most_states:
            self._reset()
        state, best = self.start, None
        for c in token:
            step = self.steps[state]
            to = step.get(c)
            if to is None:
                after = set()
                for node, e in self.sets[state]:
                    after.add((node, e + 1))
                    for d, child in self.children[node].items():
                        after.add((child, e + (c != d)))
                to = step[c] = self._state(after)
            if to < 0:
                return best
            state = to
            if self.within[state] and (best is None or self.within[state] < best):
                best = self.within[state]
        end = self.ends[state]
        return end if end and (best is None or end < best) else best


_PARTS = re.compile(r"[^\W_]+")
_EDGES = "\"'“”„«»‘’.,;:!?()[]{}<>%&$#*-_/|\\~+="


class ToxicityFeatures:
    """Counts of a text; remembers the tokens it has seen, up to a bound."""

    NAMES = ("terms", "misspelled", "density", "quoted", "direct")

    def __init__(self, entries: list[str], remembered: int = 500_000):
        self.automaton, self.remembered = LexiconAutomaton(entries), remembered
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, str]] = {}

    def _learn(self, tokens: set[str]) -> None:
        new = tokens - self.clean
        new -= self.hits.keys()
        if len(self.clean) + len(self.hits) + len(new) > self.remembered:
            self.clean, self.hits = set(), {}
            new = tokens
        match = self.automaton.match
        for t in new:
            word = t.strip(_EDGES)
            found = match(word)
            if found is None and not word.isalnum():
                found = min(filter(None, map(match, _PARTS.findall(word))), default=None)
            if found is None:
                self.clean.add(t)
            else:
                self.hits[t] = found

    def many(self, raw: list[str]) -> list[tuple]:
        split = [t.lower().split() for t in raw]
        self._learn(set().union(*split))
        return [self._one(w) if not self.hits.keys().isdisjoint(w) else (0, 0, 0, 0, len(w)) for w in split]

    def _one(self, w: list[str]) -> tuple:
        """(terms, misspelled, quoted, direct, words) of one text with hits."""
        terms = misspelled = quoted = direct = 0
        for k, t in enumerate(w):
            if (hit := self.hits.get(t)) is None:
                continue
            terms += hit[0] == 0
            misspelled += hit[0] > 0
            before, after = w[max(0, k - WINDOW) : k], w[k + 1 : k + 1 + WINDOW]
            here = t.strip("".join(set(_EDGES) - set(QUOTES)))
            opened = sum(c in QUOTES for x in before for c in x) + (here[:1] in QUOTES)
            closed = sum(c in QUOTES for x in after for c in x) + (here[-1:] in QUOTES)
            quoted += (opened % 2 == 1 and closed > 0) or any(x.strip(_EDGES) in REPORTING for x in before)
            direct += any(x.strip(_EDGES) in ADDRESS for x in before + after)
        return terms, misspelled, quoted, direct, len(w)

    @staticmethod
    def vector(counts: tuple) -> tuple[float, ...]:
        terms, misspelled, quoted, direct, words = counts
        hits = max(1, terms + misspelled)
        density = math.log1p(1000 * terms / max(1, words))
        return math.log1p(terms), math.log1p(misspelled), density, quoted / hits, direct / hits


@dataclass(frozen=True)
class ToxicityModel:
    entries: tuple[str, ...]
    weights: tuple[float, ...]
    centre: tuple[float, ...] = (0.0,) * 5
    scale: tuple[float, ...] = (1.0,) * 5

    def score(self, counts: tuple) -> float:
        v = ToxicityFeatures.vector(counts)
        z = self.weights[0] + sum(w * (x - c) / s for w, x, c, s in zip(self.weights[1:], v, self.centre, self.scale))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(
    toxic: list[str], clean: list[str], least_docs: int = 6, log_odds: float = 3.0, most: int | None = None, inflected: bool = False
) -> list[str]:
    """Words and stems (4 to 8 letters, marked ``*``) far more frequent in toxic texts.

    Of a stem and its extensions that stand for nearly the same texts, the longest is taken, a
    whole word before a stem. A stem covers its other extensions; with ``inflected`` not the whole words that allow
    more edits than it, whose misspelled forms only they accept. Every such term is taken, unless a caller asks for the
    ``most`` of the greatest log odds.
    """

    def seen(sample):
        count = Counter()
        for text in sample:
            found = set(_PARTS.findall(text.lower()))
            count.update({w[:n] + "*" for w in found for n in range(4, min(8, len(w)) + 1)} | found)
        return count

    t, c = seen(toxic), seen(clean)
    nt, nc = len(toxic) + 1, len(clean) + 1

    def odds(e):
        return math.log((t[e] + 0.5) / nt) - math.log((c[e] + 0.5) / nc)

    good = {e: n for e, n in t.items() if n >= least_docs and len(e) >= 3 and odds(e) >= log_odds}
    taken: list[str] = []
    for e, n in sorted(good.items(), key=lambda x: (-x[1], -len(x[0]), x[0].endswith("*"), x[0])):
        word = e.removesuffix("*")
        longer = e.endswith("*") and any(m >= 0.9 * n and x != e and x.startswith(word) for x, m in good.items())
        edits = allowed_edits(e) if inflected and not e.endswith("*") else 0
        covered = any(x.endswith("*") and word.startswith(x[:-1]) and (not edits or edits <= allowed_edits(x)) for x in taken)
        if not longer and not covered:
            taken.append(e)
    return sorted(taken, key=lambda e: -odds(e))[:most] if most is not None and len(taken) > most else taken


def fit(
    docs: DataFrame, labels: DataFrame, training: Column, per_class: tuple[int, int] = (4000, 2000), max_chars: int = 50_000,
    most: int | None = None,
) -> ToxicityModel:
    """Fits on a bounded sample: at most ``per_class`` whole texts of label 0 and 1.

    The lexicon has every term that the sample teaches, so the sample bounds it, unless ``most`` asks for fewer.

    Half of each class gives the lexicon, the other half the weights. The weights are set back to the
    shares of the classes among all training labels. Without texts of both classes
    every text scores the share of label 1 (0.5 without labels).
    """
    sample = labelled_sample(docs, labels, "toxic", training, per_class, max_chars).select("doc_id", "text", "y").collect()
    sample.sort(key=lambda r: r.doc_id)
    counts = {r.toxic: r["count"] for r in labels.where(training).groupBy("toxic").count().collect()}
    part = {y: [r.text for r in sample if r.y == y] for y in (0, 1)}
    known = counts.get(0, 0) + counts.get(1, 0)
    if len(part[0]) < 2 or len(part[1]) < 2:
        share = min(max(counts.get(1, 0) / known, 1e-3), 1 - 1e-3) if known else 0.5
        return ToxicityModel((), (math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0))
    entries = learn_lexicon(part[1][::2], part[0][::2], least_docs=max(2, min(6, len(part[1]) // 40)), most=most, inflected=True)
    features = ToxicityFeatures(entries)
    x = np.array([features.vector(f) for y in (0, 1) for f in features.many(part[y][1::2])])
    y = np.repeat([0.0, 1.0], [len(part[k][1::2]) for k in (0, 1)])
    centre, scale = x.mean(0), x.std(0) + 1e-6
    w = logistic((x - centre) / scale, y, ridge=0.1)
    w[0] += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return ToxicityModel(tuple(entries), tuple(w), tuple(centre), tuple(scale))


def score(docs: DataFrame, model: ToxicityModel, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, and the counts of hits.

    Empty and null texts have no hits; a repeated row gives a row each; an empty table none; other
    columns are not read. Nothing is shuffled.
    """

    def make():
        features = ToxicityFeatures(list(model.entries))

        def run(batches):
            for b in batches:
                raw, ids, held = b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist()
                for at in range(0, len(raw), 1000):
                    found = features.many(raw[at : at + 1000])
                    scores = [model.score(x) for x in found]
                    yield batch(
                        _ARROW, doc_id=ids[at : at + 1000], held_out=held[at : at + 1000], score=scores,
                        predicted=[int(s >= 0.5) for s in scores], n_terms=[x[0] for x in found],
                        n_misspelled=[x[1] for x in found], n_quoted=[x[2] for x in found], n_direct=[x[3] for x in found],
                    )

        return run

    return map_arrow(texts(docs, id_col, text_col).select("doc_id", "text", held_out.alias("held_out")), make, SCHEMA)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""

    def make():
        features = ToxicityFeatures(list(model.entries))
        return lambda raw: [model.score(x) < threshold for k in range(0, len(raw), 1000) for x in features.many(raw[k : k + 1000])]

    return where_text(docs, make, text_col)
