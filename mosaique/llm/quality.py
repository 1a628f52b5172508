"""Quality by a factorisation machine.

A text's features are its hashed words (log counts at length one), statistics
of its structure (shares of each kind of character, of repeated words, of short
lines and so on) and metadata (the stored character count). The machine adds
low-rank interactions of all pairs of features to a linear model (Rendle, 2010);
they cost linear time by 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Training takes at most ``sample`` labelled rows in the order of a hash of the
id: their features, not their texts, go to the driver, where AdaGrad runs over
mini-batches. The machine's outputs are made probabilities by a logistic curve
fitted to outputs for rows that machines trained on the other folds have not seen
(Platt, 1999), so that few labels do not give scores all on one side. Scoring
covers all rows and whole texts.

Rows: null and empty texts have no words and the statistics of nothing. A null
character count is taken from the text. Null and repeated doc_ids keep their
rows; repeated ones count once in training. Without labels, or with one class
only, the score is that class's (0 without labels). An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaique.llm.common import labelled_sample

#: Buckets of hashed words, rank of the interactions, words a task remembers.
BUCKETS, RANK, MEMORY = 1 << 13, 8, 200_000
#: Rounds over the sample, rows of a mini-batch, step size, weight decay.
EPOCHS, BATCH, STEP, DECAY = 12, 64, 0.05, 1e-4
#: Parts of the sample for the curve from outputs to probabilities.
FOLDS = 4
#: Statistics are clipped at so many standard deviations.
CLIP = 4.0

_PUNCTUATION = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
STATISTICS = (
    "characters", "words", "bytes_per_char", "word_length", "longest_word", "upper", "lower", "digits",
    "punctuation", "space", "lines", "line_length", "short_lines", "ended_lines", "distinct_words", "top_word",
    "repeated_pairs", "stored_chars", *(f"share_{c:02x}" for c in _PUNCTUATION),
)


def statistics(text: str, words: list[str], counts: Counter, n_chars: float | None) -> list[float]:
    """The values of STATISTICS; shares lie in 0 to 1, sizes are logarithms."""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = max(1, len(raw)), max(1, len(words))
    upper, lower, digits = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum())
    punctuation = hist[_PUNCTUATION]
    lines = text.split("\n")
    pairs = len(set(zip(words, words[1:])))
    stored = len(text) if n_chars is None or math.isnan(n_chars) else max(0.0, n_chars)
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        len(raw) / max(1, len(text)),
        sum(map(len, words)) / size / 16,
        math.log1p(max(map(len, counts), default=0)),
        upper / n,
        lower / n,
        digits / n,
        int(punctuation.sum()) / n,
        int(hist[9:14].sum() + hist[32]) / n,
        math.log1p(len(lines)),
        math.log1p(len(text) / len(lines)),
        sum(len(x) < 20 for x in lines) / len(lines),
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines),
        len(counts) / size,
        max(counts.values(), default=0) / size,
        1 - pairs / max(1, len(words) - 1),
        math.log1p(stored),
        *np.sqrt(punctuation / n).tolist(),
    ]


class Features:
    """Bucket numbers, their values and the statistics of whole texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if len(self.known) > MEMORY:
            self.known.clear()
        b = self.known[word] = zlib.crc32(re.sub(r"\d", "0", word).encode("utf-8", "surrogatepass")) % BUCKETS
        return b

    def of(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        words = text.lower().split()
        counts = Counter(words)
        known = self.known.get
        at = [known(w, -1) for w in counts]
        if -1 in at:
            at = [self.bucket(w) if b < 0 else b for w, b in zip(counts, at)]
        tally = np.bincount(at, weights=list(counts.values()), minlength=1) if at else np.zeros(1)
        idx = np.flatnonzero(tally)
        value = np.log1p(tally[idx])
        norm = math.sqrt(float(value @ value))
        return idx, value / norm if norm else value, statistics(text, words, counts, n_chars)


@dataclass
class Model:
    constant: float | None = 0.0  # the score where nothing could be learned
    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))  # buckets, then statistics
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    curve: tuple[float, float] = (0.0, 1.0)  # offset and slope from outputs to log-odds

    def dense(self, stats) -> np.ndarray:
        z = (np.asarray(stats, float) - self.mean) / self.scale
        return np.clip(z, -CLIP, CLIP) / math.sqrt(len(STATISTICS))

    def score(self, idx: np.ndarray, value: np.ndarray, stats: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        x = self.curve[0] + self.curve[1] * self.output(idx, value, stats)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def output(self, idx: np.ndarray, value: np.ndarray, stats: list[float]) -> float:
        d = self.dense(stats)
        v, u = self.v[idx], self.v[BUCKETS:]
        sums = value @ v + d @ u
        squares = (value**2) @ (v**2) + (d**2) @ (u**2)
        return float(self.bias + value @ self.w[idx] + d @ self.w[BUCKETS:] + 0.5 * float((sums**2 - squares).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11) -> Model:
    """A machine fitted to (buckets, values, statistics) and labels by AdaGrad on the logistic loss."""
    stats = np.array([r[2] for r in rows])
    model = Model(None, mean=stats.mean(axis=0), scale=np.maximum(stats.std(axis=0), 1e-3))
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATISTICS)
    w, v = np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = math.log(base / (1 - base))
    gw, gv, gb = np.full(size, 1e-4), np.full((size, RANK), 1e-4), 1e-4
    tail = np.arange(BUCKETS, size)
    full = [(np.concatenate((i, tail)), np.concatenate((x, model.dense(s)))) for i, x, s in rows]
    for _ in range(EPOCHS):
        order = rng.permutation(len(full))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            idx = np.concatenate([full[i][0] for i in part])
            x = np.concatenate([full[i][1] for i in part])
            starts = np.concatenate(([0], np.cumsum([len(full[i][0]) for i in part])[:-1]))
            doc = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(idx))))
            vx = v[idx] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
            z = bias + np.add.reduceat(w[idx] * x, starts) + pairs
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gx = g[doc] * x
            touched, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, gx, len(touched)) + DECAY * w[touched]
            inner = gx[:, None] * (sums[doc] - vx)
            dv = np.stack([np.bincount(where, inner[:, f], len(touched)) for f in range(RANK)], axis=1)
            dv += DECAY * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= STEP * dw / np.sqrt(gw[touched])
            v[touched] -= STEP * dv / np.sqrt(gv[touched])
            gb += float(g.sum()) ** 2
            bias -= STEP * float(g.sum()) / math.sqrt(gb)
    model.bias, model.w, model.v = bias, w, v
    return model


def _curve(output: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[float, float]:
    """Offset and slope of the logistic curve of labels over outputs, with targets a little inside 0 and 1."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x, a = np.column_stack((np.ones(len(y)), np.clip(output, -30, 30))), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - target) + ridge * a)
        a -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


def calibrated(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> Model:
    """A machine fitted to all rows, with the curve that outputs for rows unseen ask for."""
    rng, fold = np.random.default_rng(seed), np.zeros(len(y), int)
    for c in (0, 1):  # each class in all parts
        own = np.flatnonzero(y == c)
        fold[rng.permutation(own)] = np.arange(len(own)) % FOLDS
    output = np.zeros(len(y))
    for k in range(FOLDS):
        part, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(part) and len(rest):
            machine = train([rows[i] for i in rest], y[rest])
            output[part] = [machine.output(*rows[i]) for i in part]
    model = train(rows, y)
    model.curve = _curve(output, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, out: Column, sample: int = 6_000) -> Model:
    """The model learned from ``labels`` (doc_id, quality), rows where ``out`` holds left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for pdf in batches:
            rows = [features.of(t, n) for t, n in zip(pdf["text"], pdf["n_chars"])]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "y": pdf["y"],
                    "idx": [r[0].astype("<i4").tobytes() for r in rows],
                    "value": [r[1].astype("<f4").tobytes() for r in rows],
                    "stats": [np.array(r[2], "<f8").tobytes() for r in rows],
                }
            )

    # at most `sample` rows of a long and an int
    known = F.broadcast(labelled_sample(labels, "quality", out, sample))
    got = (
        docs.select("doc_id", "text", _stored(docs).alias("n_chars"))
        .join(known, "doc_id")
        .mapInPandas(run, "doc_id long, y int, idx binary, value binary, stats binary")
        .groupBy("doc_id")
        .agg(F.min(F.struct("y", "idx", "value", "stats")).alias("x"))
        .select("doc_id", "x.*")
        .toPandas()
        .sort_values("doc_id")
    )
    y = got["y"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return Model(constant=float(y[0]) if len(y) else 0.0)
    rows = [
        (np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4").astype(float), np.frombuffer(s, "<f8"))
        for i, x, s in zip(got["idx"], got["value"], got["stats"])
    ]
    return calibrated(rows, y)


def scorer(docs: DataFrame, model: Model) -> Column:
    """A column of scores of the rows of ``docs``."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        features = Features()
        for text, n_chars in parts:
            yield pd.Series([model.score(*features.of(t, n)) for t, n in zip(text, n_chars)], dtype="float64")

    return run("text", _stored(docs))


def _stored(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    return docs.select("doc_id", scorer(docs, model).alias("score"))
