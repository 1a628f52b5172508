"""Toxicity by maximum-scoring segments over token log-odds.

A token is a word without outer punctuation, lower-cased; its units are the word
and its beginnings of 4 to 8 letters, so that inflected forms share evidence.
Units get the log-odds of their document counts in toxic against other training
documents with a Dirichlet prior in proportion to their counts in *all*
documents (Monroe, Colaresi and Quinn, 2008). A token scores by its most
significant unit; tokens without a significant one score ``DRIFT``.

One linear scan (Ruzzo and Tompa, 1999) finds all maximal segments of a text.
Under no toxicity the number of segments of score S or more in n tokens is
Poisson with mean K n exp(-lambda S) (Karlin and Altschul, 1990); lambda solves
the moment equation of the clean token scores and K matches the clean segments
seen. Significant segments are the passages reported; the best one's
extreme-value tail and the sum of all go into a logistic link, fitted on the
same training rows.

Training takes at most ``sample`` labelled rows in the order of a hash of the
id; the prior counts and the scoring cover all rows and whole texts. The prior
weighs as much as a twentieth of the training documents, so that few labels
are not drowned by it, and never more than ``PRIOR`` documents.

Rows: null and empty texts have no segment and get the score of a text without
any. Null doc_ids keep their rows; repeated doc_ids keep theirs and count once
in training, by the least of their texts. Without labels, or with one class only, the score is that class's
(0 without labels). An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaique.llm.common import cut, drop_cut, labelled_sample

PREFIXES = (4, 5, 6, 7, 8)
#: Score of a token without evidence; keeps the mean score of clean text below zero.
DRIFT = -0.1
#: Least |z| and log-odds of a unit in use, highest score of a token.
LEAST_Z, LEAST_ODDS, CEILING = 3.5, 1.5, 8.0
#: Pseudo-documents of the prior: a share of the training documents, and at most.
PRIOR_SHARE, PRIOR = 0.05, 500.0
#: Chance, per document, up to which a segment counts as significant.
ALPHA = 0.01
#: Words a task remembers; beyond that it starts anew.
MEMORY = 200_000

_OUTER = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha()) + "«»“”‘’„…¿¡–—"


def units(word: str) -> list[str]:
    """The word without outer punctuation, and its beginnings marked by ``*``."""
    w = word.strip(_OUTER)
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) > k)] if w else []


def segments(scores: list[float], at: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last + 1) of a text.

    ``scores`` are the tokens' scores, ``at`` the places of the positive ones;
    the scan visits those alone, as a maximal segment begins and ends with one.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    before, after = total[at].tolist(), total[np.asarray(at, dtype=np.int64) + 1].tolist()
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last + 1
    for i, left, right in zip(at, before, after):
        first = i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j -= 1
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, i + 1))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(r - lo, a, b) for lo, r, a, b in kept]


@dataclass
class Model:
    scores: dict[str, tuple[float, float]] = field(default_factory=dict)  # unit: score, |z|
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    constant: float | None = 0.0  # the score where nothing could be learned

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def token(self, word: str) -> float:
        found = [self.scores[u] for u in units(word) if u in self.scores]
        s = max(found, key=lambda x: x[1])[0] if found else DRIFT
        if len(self.known) > MEMORY:
            self.known.clear()
        self.known[word] = s
        return s

    def tokens(self, text: str | None) -> list[float]:
        known, token = self.known.get, self.token
        out = []
        for w in (text or "").lower().split():
            s = known(w)
            out.append(token(w) if s is None else s)
        return out

    def expected(self, score: float, n: int) -> float:
        """Segments of this score or more that a clean text of n tokens has by chance."""
        return self.k * n * math.exp(-self.lam * score)

    def measure(self, text: str | None) -> tuple[float, float, int, list[tuple[float, int, int]]]:
        """(-log10 of the best segment's tail, sum of the significant scores, tokens, significant segments)."""
        s = self.tokens(text)
        at = np.flatnonzero(np.asarray(s) > 0).tolist() if s else []
        if not at:
            return 0.0, 0.0, len(s), []
        found = segments(s, at)
        best = max(x[0] for x in found)
        # -log10(1 - exp(-E)) without loss for tiny E
        tail = -math.log10(max(-math.expm1(-self.expected(best, len(s))), 1e-30))
        good = [x for x in found if self.expected(x[0], len(s)) <= ALPHA]
        return tail, sum(x[0] for x in good), len(s), good

    def score(self, tail: float, total: float) -> float:
        if self.constant is not None:
            return self.constant
        w = self.weights
        x = w[0] + w[1] * tail + w[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, n = (Counter(), Counter()), [0, 0]
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"]):
            n[y] += 1
            counts[y].update({u for w in set((text or "").lower().split()) for u in units(w)})
    names = list(counts[0].keys() | counts[1].keys())
    yield pd.DataFrame(
        {
            "unit": ["", *names],
            "clean": [n[0], *(counts[0][u] for u in names)],
            "toxic": [n[1], *(counts[1][u] for u in names)],
        }
    )


def _corpus_counts(names: list[str]):
    place = {u: i for i, u in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        counts, n = np.zeros(len(names), np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                n += 1
                hit: set[int] = set()
                for w in set((text or "").lower().split()):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) > MEMORY:
                            known.clear()
                        ids = known[w] = tuple(place[u] for u in units(w) if u in place)
                    hit.update(ids)
                counts[list(hit)] += 1
        has = np.flatnonzero(counts)
        yield pd.DataFrame({"place": np.append(has, -1), "n": np.append(counts[has], n)})

    return run


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, n_toxic: int, n_clean: int, n_docs: int):
    """(log-odds, z) of each unit's document counts with a Dirichlet prior."""
    prior = min(PRIOR, PRIOR_SHARE * (n_toxic + n_clean))
    a = np.maximum(prior * corpus / n_docs, 1e-3)
    odds = lambda y, n: np.log((y + a) / np.maximum(n + prior - y - a, 0.5))
    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    return delta, delta / np.sqrt(1 / (toxic + a) + 1 / (clean + a))


def _chances(model: Model):
    """What clean texts show: (kind 0, token score, tokens) and (kind 1, segment score, segments), a task's sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                s = np.asarray(model.tokens(text))
                at = np.flatnonzero(s > 0)
                counts[0].update(dict(zip(*(x.tolist() for x in np.unique(np.round(s, 2), return_counts=True)))))
                # three digits, so that texts of any length give few values
                counts[1].update(float(f"{x[0]:.3g}") for x in (segments(s, at.tolist()) if len(at) else []))
        rows = [(k, v, n) for k in (0, 1) for v, n in counts[k].items()]
        yield pd.DataFrame(rows, columns=["kind", "value", "n"])

    return run


def _measured(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [model.measure(text)[:2] for text in pdf["text"]]
            yield pd.DataFrame(rows, columns=["tail", "total"]).assign(doc_id=pdf["doc_id"], y=pdf["y"])

    return run


def _moment_root(value: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum(share * exp(lambda * value)) = 1; 1 where no such value exists."""
    f = lambda x: float((share * np.exp(x * value)).sum()) - 1
    if value.max(initial=-1) <= 0 or (share * value).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 50:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, out: Column, sample: int = 12_000, lexicon: int = 20_000, least_docs: int = 3
) -> Model:
    """The model learned from ``labels`` (doc_id, toxic), rows where ``out`` holds left out.

    At most ``lexicon`` units enter, those that part the classes most among the ones of ``least_docs`` training documents.
    """
    known = labelled_sample(labels, "toxic", out, sample)
    # at most `sample` rows of a long and an int
    train = cut(
        docs.select("doc_id", "text")
        .join(F.broadcast(known), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("y").alias("y"))
    )
    counts = (
        train.mapInPandas(_unit_counts, "unit string, clean long, toxic long")
        .groupBy("unit")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("unit") == "") | (F.col("clean") + F.col("toxic") >= least_docs))
    )
    counts = cut(counts)
    n = counts.where("unit = ''").first()
    n_clean, n_toxic = (n["clean"], n["toxic"]) if n else (0, 0)
    if not n_clean or not n_toxic:
        drop_cut(counts), drop_cut(train)
        return Model(constant=1.0 if n_toxic else 0.0)
    share = (F.col("clean") + F.col("toxic")) / F.lit(n_clean + n_toxic)
    gap = F.abs(F.col("toxic") / F.lit(n_toxic) - F.col("clean") / F.lit(n_clean))
    top = counts.where("unit <> ''").orderBy((gap / F.sqrt(share)).desc(), "unit").limit(lexicon).toPandas()
    drop_cut(counts)
    names = top["unit"].tolist()
    seen = (
        docs.select("text")
        .mapInPandas(_corpus_counts(names), "place int, n long")
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    corpus = np.zeros(len(names))
    real = seen[seen["place"] >= 0]
    corpus[real["place"].to_numpy()] = real["n"].to_numpy()
    n_docs = int(seen.loc[seen["place"] < 0, "n"].sum())
    delta, z = log_odds(top["toxic"].to_numpy(float), top["clean"].to_numpy(float), corpus, n_toxic, n_clean, n_docs)
    model = Model(
        {
            u: (DRIFT if d < 0 else min(float(d), CEILING), abs(float(x)))
            for u, d, x in zip(names, delta, z)
            if abs(x) >= LEAST_Z and abs(d) >= LEAST_ODDS
        },
        constant=None,
    )
    # a row for each score of a token, to two decimals, and of a segment, to three digits
    chances = (
        train.where("y = 0")
        .mapInPandas(_chances(model), "kind int, value double, n long")
        .groupBy("kind", "value")
        .agg(F.sum("n").alias("n"))
        .toPandas()
        .sort_values("value")
    )
    tokens, found = (chances[chances["kind"] == k] for k in (0, 1))
    size = max(1.0, float(tokens["n"].sum()))
    model.lam = _moment_root(tokens["value"].to_numpy(float), tokens["n"].to_numpy(float) / size)
    # segments that clean texts have, from a score on at which they are few
    value, above = found["value"].to_numpy(float), found["n"].to_numpy(float)
    above = above[::-1].cumsum()[::-1]
    rare = np.flatnonzero(above <= 0.1 * above.max(initial=0))
    at = rare[0] if len(rare) else len(value) - 1
    least, many = (value[at], above[at]) if len(value) else (1.0, 0.0)
    model.k = (float(many) + 0.5) / (size * math.exp(-min(600.0, model.lam * float(least))))
    x = train.mapInPandas(_measured(model), "tail double, total double, doc_id long, y int").toPandas().sort_values("doc_id")
    drop_cut(train)
    model.weights = tuple(_logistic(np.column_stack((x["tail"], np.log1p(x["total"]))), x["y"].to_numpy(float)).tolist())
    return model


def scorer(model: Model) -> Column:
    """A column of (score, passages) of the column ``text``.

    Passages are the significant segments (score, start, stop), in tokens.
    """

    @F.pandas_udf("score double, passages array<struct<score: double, start: long, stop: long>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                tail, total, _, good = model.measure(text)
                rows.append((model.score(tail, total), [dict(zip(("score", "start", "stop"), g)) for g in good]))
            yield pd.DataFrame(rows, columns=["score", "passages"])

    return run("text")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row."""
    return docs.select("doc_id", scorer(model).alias("_found")).select("doc_id", "_found.*")
