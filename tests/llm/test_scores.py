import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique.llm import quality, queries, toxicity
from mosaique.llm.common import held_out, labelled_sample


def brute_segments(s):
    """Maximal scoring subsequences, by definition: the best one, then the same to its left and right."""
    def of(a, b):
        best, at = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > best + 1e-12:
                    best, at = total, (i, j + 1)
        if at is None:
            return []
        return [*of(a, at[0]), (best, *at), *of(at[1], b)]

    return of(0, len(s))


def test_segments_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        s = rng.integers(-4, 4, rng.integers(1, 14)) + rng.random(1) * 1e-3
        s = (s + rng.random(len(s)) * 1e-4).tolist()  # no ties
        got = toxicity.segments(s, [i for i, x in enumerate(s) if x > 0])
        want = brute_segments(s)
        assert [x[1:] for x in got] == [x[1:] for x in want]
        assert np.allclose([x[0] for x in got], [x[0] for x in want])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "kmrst" for b in ("alo", "eni", "oru", "usa", "ite", "ama")]
    bad = ["vilest", "rotten", "wretch", "fiend"]
    rows, labels = [], []
    for i in range(500):
        text = rng.choice(words, rng.integers(5, 60)).tolist()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.integers(0, len(text)), str(rng.choice(bad)) + rng.choice(["", "s", "!"]))
        poor = i % 4 == 0
        said = " ".join(text)
        said = said.upper().replace(" ", "!! ") if poor else f"{said.capitalize()}."
        rows.append((i, said, len(said), "x"))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000, None, None, "x"), (1001, "", 0, "x"), (1002, "word " * 60_000, 300_000, "x"), (None, "rotten wretch", 13, "x"), (3, rows[3][1], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, y string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, target, at):
    both = {(r["doc_id"], r["score"]): r[target] for r in scored.join(labels, "doc_id").collect()}
    return np.mean([(s >= at) == y for (_, s), y in both.items()])


def test_toxicity(corpus):
    docs, labels = corpus
    out = held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, labels, out)
    scored = toxicity.score(docs, model).cache()
    assert scored.count() == docs.count()
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert accuracy(scored.where(out), labels, "toxic", 0.5) > 0.97
    by_id = {r["doc_id"]: r for r in scored.collect()}
    assert by_id[1000]["score"] == by_id[1001]["score"] < 0.5 and by_id[None]["score"] > 0.5
    # passages point at the tokens
    passage = max(by_id[None]["passages"], key=lambda p: p["score"])
    assert (passage["start"], passage["stop"]) == (0, 2)
    again = toxicity.score(docs, toxicity.fit(docs, labels, out))
    assert {tuple(r)[:2] for r in again.collect()} == {tuple(r)[:2] for r in scored.collect()}


def test_toxicity_query_against_brute_force(spark):
    """op2_toxicity beside counts, log-odds and segments taken by definition from the same tables."""
    import math
    import zlib

    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    train = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 and i in docs and y is not None}
    held = {i: {u for w in (t or "").lower().split() for u in toxicity.units(w)} for i, t in docs.items()}
    n1 = sum(train.values())
    n0, prior = len(train) - n1, min(500.0, 0.05 * len(train))
    model = toxicity.fit(
        spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), held_out("doc_id", 5, 0)
    )
    seen = {}
    for i, us in held.items():
        for u in us:
            x = seen.setdefault(u, [0, 0, 0])
            x[2] += 1
            if i in train:
                x[train[i]] += 1
    want = {}
    for u, (clean, toxic, n) in seen.items():
        if clean + toxic >= 3:
            a = prior * n / len(docs)
            delta = math.log((toxic + a) / (n1 + prior - toxic - a)) - math.log((clean + a) / (n0 + prior - clean - a))
            z = abs(delta) / math.sqrt(1 / (toxic + a) + 1 / (clean + a))
            if z >= 3.5 and abs(delta) >= 1.5:
                want[u] = (min(delta, 8.0) if delta > 0 else -0.1, z)
    assert set(model.scores) == set(want) and len(want) > 10
    assert all(np.allclose(model.scores[u], want[u]) for u in want)
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    assert set(got) == set(docs)
    checked = 0
    for i, text in docs.items():
        s = []
        for w in (text or "").lower().split():
            found = [want[u] for u in toxicity.units(w) if u in want]
            s.append(max(found, key=lambda x: x[1])[0] if found else -0.1)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        if len(s) > 120:
            continue
        best = [x[0] for x in brute_segments(s)]
        e = [model.k * len(s) * math.exp(-model.lam * x) for x in best]
        tail = -math.log10(max(1e-30, -math.expm1(-min(e)))) if e else 0.0
        total = math.log1p(sum(x for x, y in zip(best, e) if y <= 0.01))
        w = model.weights
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(w[0] + w[1] * tail + w[2] * total))), abs=1e-6)
        checked += 1
    assert checked > 100
    out = [i for i in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] for i in out if labels[i]]) >= 0.6
    assert np.mean([got[i]["predicted"] for i in out if not labels[i]]) <= 0.01


def test_repeated_ids_count_once(spark, corpus):
    docs, labels = corpus
    out = held_out("doc_id", 5, 0)
    once, twice = toxicity.fit(docs, labels, out), toxicity.fit(docs.unionByName(docs.where("doc_id % 7 = 0")), labels, out)
    # the prior sees every row; the training counts do not
    assert set(once.scores) == set(twice.scores)


def test_quality(corpus):
    docs, labels = corpus
    out = held_out("doc_id", 4, 2)
    model = quality.fit(docs, labels, out)
    scored = quality.score(docs, model).cache()
    assert scored.count() == docs.count()
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert accuracy(scored.where(out), labels, "quality", 0.7) > 0.97
    assert quality.score(docs.drop("n_chars"), model).count() == docs.count()


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.Model(None, 0.3, rng.normal(size=quality.BUCKETS + len(quality.STATISTICS)), rng.normal(size=(quality.BUCKETS + len(quality.STATISTICS), 8)))
    m.mean, m.scale = np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS))
    idx, value, stats = np.array([3, 90, 700]), np.array([0.1, 0.2, 0.05]), np.zeros(len(quality.STATISTICS)).tolist()
    stats[2] = 0.7
    x = {**dict(zip(idx.tolist(), value)), quality.BUCKETS + 2: m.dense(stats)[2]}
    z = m.bias + sum(m.w[i] * v for i, v in x.items())
    z += sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in x for j in x if i < j)
    assert m.score(idx, value, stats) == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_query_against_brute_force(spark):
    """op3_quality beside sums over all pairs of features, and what it refuses with some 300 labels."""
    import zlib

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    m = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), held_out("doc_id", 4, 2))
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, sf).collect()}
    rows = docs.collect()
    assert set(got) == {r["doc_id"] for r in rows}
    for r in rows[:150]:
        idx, value, stats = quality.Features().of(r["text"], r["n_chars"])
        places = np.concatenate((idx, quality.BUCKETS + np.arange(len(quality.STATISTICS))))
        x = np.concatenate((value, m.dense(stats)))
        pairs = np.triu((m.v[places] @ m.v[places].T) * np.outer(x, x), 1).sum()
        z = m.curve[0] + m.curve[1] * (m.bias + m.w[places] @ x + pairs)
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-5)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    out = [i for i, y in labels.items() if y is not None and i in got and got[i]["held_out"]]
    assert np.mean([1 - got[i]["predicted"] for i in out if not labels[i]]) >= 0.85
    assert np.mean([got[i]["predicted"] for i in out if labels[i]]) >= 0.97


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_nothing_to_learn(spark, corpus, operator):
    docs, labels = corpus
    out = held_out("doc_id", 5, 0)
    target = "toxic" if operator is toxicity else "quality"
    none = operator.fit(docs, labels.limit(0), out)
    assert {r["score"] for r in operator.score(docs, none).collect()} == {0.0}
    ones = operator.fit(docs, labels.withColumn(target, F.lit(1)), out)
    assert {r["score"] for r in operator.score(docs, ones).collect()} == {1.0}
    assert operator.score(docs.limit(0), ones).count() == 0
    assert operator.fit(docs.limit(0), labels, out).constant == 0.0


def test_sample_is_bounded_and_leaves_out_what_is_held_out(spark):
    import zlib

    labels = spark.createDataFrame([(i % 40, 1, i % 2) for i in range(80)] + [(None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")
    got = labelled_sample(labels, "toxic", held_out("doc_id", 5, 0), 10).collect()
    assert len(got) == 10 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)
    assert len({r["doc_id"] for r in got}) == 10
