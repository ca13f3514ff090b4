"""Toxicity by a linear-chain conditional random field over tokens.

Labels are given by document, so tokens are labelled from them: over the training sample, a word or
word beginning that occurs in several toxic documents and (almost) no clean one is evidence, and a
toxic document's tokens with evidence are labelled toxic. The field's features are words and word
beginnings found often enough, with a constant; its transitions join neighbours into spans.
Forward-backward marginals give offending offsets (tokens of probability 1/2 or more, neighbours
joined) and three sums (expected toxic tokens, their share, the highest) from which a logistic
regression, weighted to the labels' own frequencies, gives the document's score.

Fitted on at most ``per_class`` documents of each class (bounded, see ``labelled``), never on held-out
rows, with at most ``FEATURES`` features (all evidence and the most frequent others) and about
``PLAIN_CHAINS`` to twice as many chains without toxic tokens; every whole text is scored, a very long
one as a chain of its own. Columns beside doc_id and text play no part, whatever their names. Cases: a null or empty text has no tokens and scores what the
regression gives for none; repeated rows score alike; without labels of both classes every score is
1/2 of the known class's side (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .bpe import Store
from .common import documents
from .labelled import PER_CLASS, held_out, training_sample

PREFIXES = (3, 4, 5, 6)
#: Log-odds and documents from which a feature is evidence; features kept; tokens of a training chain.
EVIDENCE, SUPPORT, FEATURES, CHAIN = 3.0, 3, 30_000, 64
#: Training chains without toxic tokens from twice as many of which on only every k-th is fitted on.
PLAIN_CHAINS = 6_000
EDGE = ".,;:!?*%$#&|\"'()[]{}<>-_/\\~`+=@^"
_TOKEN = re.compile(r"\S+")


def features(token: str) -> list[str]:
    """The word without its edges, and its beginnings (marked, so that they differ from words)."""
    w = token.strip(EDGE).lower()
    return [w, *[f"{w[:k]}~" for k in PREFIXES if len(w) > k]] if w else []


class Toxicity:
    """A fitted field: feature weights, transitions, and the regression on its marginals."""

    def __init__(self, sample: list[tuple[str, int]], counts: dict[int, int]):
        self.weights: dict[str, float] = {}
        self.base, self.trans, self.beta = -6.0, np.zeros((2, 2)), None
        self.prior = 0.5 if not counts or len(counts) == 2 else 0.75 if 1 in counts else 0.25
        if len({y for _, y in sample}) == 2:
            self._fit(sample, counts)

    def _fit(self, sample: list[tuple[str, int]], counts: dict[int, int]) -> None:
        found = Store(features, 1 << 30)
        docs = [(text.split(), y) for text, y in sample]
        n = Counter(y for _, y in docs)
        seen = {0: Counter(), 1: Counter()}
        for tokens, y in docs:
            seen[y].update({f for t in set(tokens) for f in found[t]})
        odds = {f: math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0][f] + 0.5) / (n[0] + 1)) for f, c in seen[1].items() if c >= SUPPORT}
        # from so many documents on, no feature is expected to be in toxic ones only by chance
        share, total = n[1] / (n[0] + n[1]), Counter(c + seen[0][f] for f, c in seen[1].items())
        support = SUPPORT
        while sum(k * share**c for c, k in total.items() if c >= support) > 0.5:
            support += 1
        # one clean document in a thousand, or one by chance, does not clear a feature
        evidence = {f for f, s in odds.items() for c in [seen[1][f]] if s >= EVIDENCE and seen[0][f] <= 1 + n[0] / 1000 and c >= support}
        common = Counter({f: c + seen[0][f] for f, c in seen[1].items() if c + seen[0][f] >= 2 * SUPPORT})
        common.update({f: c for f, c in seen[0].items() if c >= 2 * SUPPORT and f not in common})
        names = sorted(evidence) + [f for f, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if f not in evidence]
        names = names[: max(FEATURES, len(evidence))]
        at = {f: i for i, f in enumerate(names)}

        words: dict[str, int] = {}
        chains, labels = [], []
        for tokens, y in docs:
            ids = [words.setdefault(t, len(words)) for t in tokens]
            toxic = [int(bool(y) and any(f in evidence for f in found[t])) for t in tokens]
            for a in range(0, len(ids), CHAIN):
                chains.append(ids[a : a + CHAIN])
                labels.append(toxic[a : a + CHAIN])
        # chains without toxic tokens are many and alike: every k-th is enough, by a fixed rule
        plain = [i for i, x in enumerate(labels) if not any(x)]
        keep = sorted({i for i, x in enumerate(labels) if any(x)} | set(plain[:: max(1, len(plain) // PLAIN_CHAINS)]))
        chains, labels = [chains[i] for i in keep], [labels[i] for i in keep]
        if not any(map(any, labels)):
            return self._regress(docs, counts)
        lengths = np.array([len(c) for c in chains])
        grid, y = np.zeros((len(chains), CHAIN), np.int64), np.zeros((len(chains), CHAIN))
        for i, (c, x) in enumerate(zip(chains, labels, strict=True)):
            grid[i, : len(c)], y[i, : len(x)] = c, x
        pairs = [(i, at[f]) for t, i in words.items() for f in found[t] if f in at]
        word, feature = (np.array(x) for x in zip(*pairs, strict=True))

        def score(theta: np.ndarray) -> np.ndarray:
            return (np.bincount(word, theta[feature], len(words)) + theta[-1])[grid]

        def gradient(d: np.ndarray) -> np.ndarray:
            by_word = np.bincount(grid.ravel(), d.ravel(), len(words))
            return np.append(np.bincount(feature, by_word[word], len(names)), d.sum())

        theta = np.zeros(len(names) + 1)
        theta[-1] = -4.0
        theta, self.trans = crf.fit(y, lengths, theta, score, gradient, rounds=40, rate=0.25, ridge=3e-6)
        self.weights = {f: float(theta[i]) for f, i in at.items() if abs(theta[i]) > 1e-3}
        self.base = float(theta[-1])
        return self._regress(docs, counts)

    def _regress(self, docs: list, counts: dict[int, int]) -> None:
        x = self.sums([p for p in self.probabilities([tokens for tokens, _ in docs])])
        y = np.array([y for _, y in docs], float)
        n = Counter(y for _, y in docs)
        share = np.array([counts[y] / n[y] for _, y in docs]) * len(docs) / sum(counts.values())
        self.beta = crf.logistic(x, y, share)

    def store(self) -> Store:
        """Scores by token as it stands in texts."""
        get, base = self.weights.get, self.base
        return Store(lambda t: base + sum([get(f, 0.0) for f in features(t)]))

    def probabilities(self, texts: list[list[str]], store: Store | None = None) -> list[np.ndarray]:
        store = store or self.store()
        return crf.marginals([np.array(list(map(store.__getitem__, t))) for t in texts], self.trans)

    @staticmethod
    def sums(marginals: list[np.ndarray]) -> np.ndarray:
        total = np.array([float(p.sum()) for p in marginals])
        size = np.array([max(1, len(p)) for p in marginals])
        top = np.array([float(p.max()) if len(p) else 0.0 for p in marginals])
        return np.column_stack([np.log1p(total), np.log(total / size + 1e-3), top])

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(marginals), self.prior)
        return crf.probability(self.sums(marginals), self.beta)


def offending(text: str, p: np.ndarray) -> list[dict]:
    """Start and stop of runs of tokens of probability 1/2 or more."""
    hot, out = p >= 0.5, []
    if not hot.any():
        return out
    for k, m in enumerate(_TOKEN.finditer(text)):
        if hot[k]:
            if k and hot[k - 1]:
                out[-1]["stop"] = m.end()
            else:
                out.append({"start": m.start(), "stop": m.end()})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def score_documents(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans array<struct<start,stop>> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = model.store()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                p = model.probabilities([t.split() for t in texts], store)
                spans = [offending(t, x) for t, x in zip(texts, p, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(p)), pa.array(spans, _SPANS)], names=["doc_id", "score", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, score double, spans array<struct<start:int,stop:int>>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS) -> Toxicity:
    return Toxicity(*training_sample(docs, labels, label_col, per_class))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
