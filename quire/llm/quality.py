"""Quality classifier: a factorisation machine over hashed words and structure statistics of the text; there is no metadata input.

A text's features are its distinct words, hashed to BUCKETS, and FIGURES of its structure (length among them), each as one of BINS ranges learned from the
sample. The score is logistic(w0 + sum w x + pairwise), where the pairwise part of low-rank factors V, by the identity 1/2 sum_f ((sum v x)^2 - sum (v x)^2), takes time linear in the features.

Learning takes a bounded sample of labelled rows (at most SAMPLE, chosen by a hash of the id) to the driver as feature numbers. Null texts are empty and scored by their figures. Labels that are
null or neither 0 nor 1 are not learned; without labels every score is 0.5, with labels of one kind the score tends to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import chunks, utf8, words

BUCKETS, BINS, RANK, SAMPLE, EPOCHS, BATCH = 1 << 15, 16, 6, 6000, 6, 64
FIGURES = ("words", "word length", "capitals", "digits", "marks", "bars", "stops", "wide bytes", "lines", "repeated lines", "distinct words", "doubled marks")
_CLASS = np.zeros((7, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,|"]] = True
_CLASS[3, ord("|")] = True
_CLASS[4, [ord("."), ord(",")]] = True
_CLASS[5, 128:] = True
_CLASS[6, 10] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of distinct words of all texts, first of each text and one more, figures by text)."""
    names, first = words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = np.unique(owner.astype(np.uint64) << np.uint64(32) | (names & np.uint64(BUCKETS - 1)))
    start = np.searchsorted(pair, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(32))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    size = np.maximum(np.diff(at) - 1, 1)
    counted = [np.diff(np.concatenate([[0], np.cumsum(c[data])])[at]) for c in _CLASS]
    mark = _CLASS[2][data]
    doubled = np.zeros(len(data), bool)
    doubled[1:] = mark[1:] & mark[:-1]
    double = np.diff(np.concatenate([[0], np.cumsum(doubled)])[at])
    lines = [t.split(b"\n") for t in texts]
    n = np.diff(first)
    figures = [np.log1p(n), (size - n) / np.maximum(n, 1), *(c / size for c in counted[:6]), np.log1p(counted[6]), [1 - len(set(x)) / len(x) for x in lines], np.diff(start) / np.maximum(n, 1), double / size]
    return (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), start, np.array(figures).T


@dataclass
class Machine:
    cuts: np.ndarray  # BINS - 1 limits by figure
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def bins(self, figures: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(c, f, side="right") for c, f in zip(self.cuts, figures.T, strict=True)], axis=1)
        return BUCKETS + at + BINS * np.arange(len(self.cuts))

    def raw(self, buckets: np.ndarray, first: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit, sums of V x by text, weight of a word by text). All words of a text weigh 1 together (as squares), as does each figure."""
        n = np.diff(first)
        x = 1 / np.sqrt(np.maximum(n, 1))

        def total(values: np.ndarray) -> np.ndarray:
            out = np.zeros((len(n), *values.shape[1:]), np.float64)
            full = np.flatnonzero(n)
            if len(full):
                out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
            return out

        v, u = self.factors[buckets], self.factors[bins]
        sums = total(v) * x[:, None] + u.sum(axis=1)
        squares = total((v * v).sum(axis=1)) * x * x + (u * u).sum(axis=(1, 2))
        linear = total(self.weights[buckets]) * x + self.weights[bins].sum(axis=1)
        return self.bias + linear + ((sums**2).sum(axis=1) - squares) / 2, sums, x

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in chunks(texts):
            buckets, first, figures = features(texts[a:b])
            out.append(1 / (1 + np.exp(-np.clip(self.raw(buckets, first, self.bins(figures))[0], -30, 30))))
        return np.concatenate(out)


def fit(rows: list[np.ndarray], figures: np.ndarray, labels: np.ndarray, seed: int = 7, rate: float = 0.08, decay: float = 1e-4) -> Machine:
    """rows: word buckets of each text. AdaGrad on the logistic loss, in an order fixed by seed."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + BINS * len(FIGURES)
    if not len(rows):
        return Machine(np.zeros((len(FIGURES), BINS - 1)), 0.0, np.zeros(size), np.zeros((size, RANK)))
    cuts = np.quantile(figures, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    share = np.clip(labels.mean(), 0.01, 0.99)
    machine = Machine(cuts, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    bins = machine.bins(figures)
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            n = np.array([len(rows[i]) for i in own])
            first = np.concatenate([[0], np.cumsum(n)])
            buckets = np.concatenate([rows[i] for i in own])
            logit, sums, x = machine.raw(buckets, first, bins[own])
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) / len(own)
            rep = np.repeat(np.arange(len(own)), n)
            where = np.concatenate([buckets, bins[own].ravel()])
            text = np.concatenate([rep, np.repeat(np.arange(len(own)), bins.shape[1])])
            value = np.concatenate([x[rep], np.ones(bins[own].size)])
            used, back = np.unique(where, return_inverse=True)
            pull = error[text] * value
            gw = np.bincount(back, pull, len(used)) + decay * machine.weights[used]
            slope = pull[:, None] * (sums[text] - machine.factors[where] * value[:, None])
            gv = np.stack([np.bincount(back, slope[:, f], len(used)) for f in range(RANK)], axis=1) + decay * machine.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += error.sum() ** 2
            machine.weights[used] -= rate * gw / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * gv / np.sqrt(seen_v[used])
            machine.bias -= rate * error.sum() / np.sqrt(seen_b)
    return machine


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """Learns from rows of docs that have a label; id_col joins the two and chooses the sample, and is no feature."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    n = known.count()
    place = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("quality")), F.lit(1 << 24))
    picked = known.where(place <= int((1 << 24) * min(1.0, sample / max(1, n)))).limit(2 * sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts):
                buckets, first, figures = features(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("_id").cast(pa.string()), part.column("_label"), pa.array([buckets[s:e].astype(np.uint16).tobytes() for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in figures], pa.binary())], ["i", "y", "words", "figures"])

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "i string, y int, words binary, figures binary").limit(4 * sample).collect())
    return fit([np.frombuffer(r[2], np.uint16).astype(np.int64) for r in found], np.array([np.frombuffer(r[3]) for r in found]).reshape(-1, len(FIGURES)), np.array([r[1] for r in found], float))


def score(df: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score", threshold: float = 0.3, predicted_col: str = "predicted") -> DataFrame:
    """df with score_col double and predicted_col int, 1 from threshold on; they replace columns of their names."""
    df = df.drop(score_col, predicted_col)
    sent = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores(utf8(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*batch.schema.names, score_col, predicted_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())]))
