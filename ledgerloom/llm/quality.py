"""Quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad by the field. A line's features are measures of its bytes and
words (length, shares of capitals, digits, marks, symbols, other scripts, mean word length, distinct
words, words that follow themselves, ending, repetition of an earlier line), each cut into bins at quantiles of the training
sample; a line has its own bins and those of the line before and after it. In training a line has its
document's label. Forward-backward marginals, weighted by line length, give the document's share of
good text, which a logistic regression turns into the score, weighted to the labels' frequencies.

Fitted on at most ``per_class`` documents of each class (bounded, see ``labelled``), never on held-out
rows; every line of every whole text is scored, a very long text as a chain of its own. Other columns
play no part and pass through ``score_documents``, but for one named score, which is replaced. Cases: a null or empty text is one empty line;
repeated rows score alike; without labels of both classes scores are constant; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import documents
from .labelled import PER_CLASS, held_out, training_sample

#: Bins are cut at so many quantiles of good and of bad documents' lines each.
CUTS, CHAIN, THRESHOLD = 8, 64, 0.3
BINS = 2 * CUTS + 1
#: Byte classes: 0 others, then as counted in ``measures``.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _k, _chars in ((3, b".,;:'\"-?()"), (4, b"!"), (5, b"|"), (6, b"#$%&*+/<=>@[\\]^_`{}~")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7
CLASSES = 7
MEASURES = CLASSES + 8


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines of all texts, lines per text, and bytes per line."""
    lines, counts, words, distinct, echo, again, final = [], [], [], [], [], [], []
    for text in texts:
        own = text.split(b"\n")
        lines += own
        counts.append(len(own))
        seen: set[bytes] = set()
        for x in own:
            w = x.split()
            words.append(len(w))
            distinct.append(len(set(w)))
            echo.append(sum(map(eq, w, w[1:])))
            again.append(x in seen and bool(w))
            final.append(x[-1:] in (b".", b"?", b'"'))
            seen.add(x)
    size = np.array([len(x) for x in lines])
    kinds = _CLASS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    out = np.zeros((len(lines), MEASURES))
    full = np.maximum(size, 1)
    for k in range(1, CLASSES + 1):
        out[:, k - 1] = np.add.reduceat((kinds == k).astype(np.int32), starts) / full
    words = np.array(words)
    out[:, CLASSES] = np.log2(size + 1)
    out[:, CLASSES + 1] = np.log2(words + 1)
    out[:, CLASSES + 2] = size / np.maximum(words, 1)
    out[:, CLASSES + 3] = np.array(distinct) / np.maximum(words, 1)
    out[:, CLASSES + 4] = again
    out[:, CLASSES + 5] = final
    out[:, CLASSES + 6] = np.isin(kinds[starts], (1, 7))
    out[:, CLASSES + 7] = np.array(echo) / np.maximum(words, 1)
    return out, np.array(counts), size


class Quality:
    """A fitted field over binned measures, and the regression on its share of good text."""

    def __init__(self, sample: list[tuple[str, int]], counts: dict[int, int]):
        self.edges, self.theta, self.trans, self.beta = None, None, np.zeros((2, 2)), None
        self.prior = 0.5 if not counts or len(counts) == 2 else 0.75 if 1 in counts else 0.25
        if len({y for _, y in sample}) == 2:
            self._fit(sample, counts)

    def cells(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Three columns of feature numbers a measure: the line's bin, the one before, the one after."""
        bins = np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])
        none = np.full((1, MEASURES), BINS)
        before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
        ends = np.cumsum(counts)
        before[np.concatenate(([0], ends[:-1]))] = BINS
        after[ends - 1] = BINS
        base = np.arange(MEASURES) * (BINS + 1)
        return np.concatenate([y + base + k * MEASURES * (BINS + 1) for k, y in enumerate((bins, before, after))], axis=1)

    def _fit(self, sample: list[tuple[str, int]], counts: dict[int, int]) -> None:
        texts = [t.encode() for t, _ in sample]
        x, lines, size = measures(texts)
        good = np.repeat([y for _, y in sample], lines) == 1
        at = np.arange(1, CUTS + 1) / (CUTS + 1)
        self.edges = [np.unique(np.concatenate([np.quantile(x[g, k], at) for g in (good, ~good)])) for k in range(MEASURES)]
        cells = self.cells(x, lines)
        cuts = [(a, min(a + CHAIN, stop), i) for i, (start, stop) in enumerate(zip(np.cumsum(lines) - lines, np.cumsum(lines), strict=True)) for a in range(start, stop, CHAIN)]
        lengths = np.array([b - a for a, b, _ in cuts])
        n = int(lengths.max())
        grid, y = np.zeros((len(cuts), n), np.int64), np.zeros((len(cuts), n))
        for k, (a, b, i) in enumerate(cuts):
            grid[k, : b - a], y[k, : b - a] = np.arange(a, b), sample[i][1]
        theta = np.zeros(3 * MEASURES * (BINS + 1))

        def score(t: np.ndarray) -> np.ndarray:
            return t[cells].sum(axis=1)[grid]

        def gradient(d: np.ndarray) -> np.ndarray:
            by_line = np.bincount(grid.ravel(), d.ravel(), len(cells))
            return np.bincount(cells.ravel(), np.repeat(by_line, cells.shape[1]), len(theta))

        self.theta, self.trans = crf.fit(y, lengths, theta, score, gradient, rounds=60, rate=0.1, ridge=1e-4)
        z = self.features(texts)
        label = np.array([v for _, v in sample], float)
        seen = Counter(v for _, v in sample)
        share = np.array([counts[v] / seen[v] for _, v in sample]) * len(sample) / sum(counts.values())
        self.beta = crf.logistic(z, label, share)

    def line_probabilities(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Probability of good, and weight, of each line of each text."""
        x, lines, size = measures(texts)
        unary = self.theta[self.cells(x, lines)].sum(axis=1)
        cuts = np.cumsum(lines)[:-1]
        return crf.marginals(np.split(unary, cuts), self.trans), np.split(size + 1.0, cuts)

    def features(self, texts: list[bytes]) -> np.ndarray:
        p, w = self.line_probabilities(texts)
        good = np.clip([float((a * b).sum() / b.sum()) for a, b in zip(p, w, strict=True)], 1e-6, 1 - 1e-6)
        return np.column_stack([np.log(good / (1 - good)), good])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(texts), self.prior)
        return crf.probability(self.features(texts), self.beta)


def score_documents(docs: DataFrame, model: Quality, text_col: str = "text") -> DataFrame:
    """docs with score double; a column of that name is replaced."""
    docs = docs.drop("score")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts))], names=[*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")


def score_ids(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id and score only: no text comes back from the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(texts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS) -> Quality:
    return Quality(*training_sample(docs, labels, label_col, per_class))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_ids(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
