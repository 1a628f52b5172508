import numpy as np
import pytest

import corpus_pipeline
from mosaique.llm import simhash
from tests.llm.test_near_dedup import union


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_roots(texts, at=0.8):
    sets = [brute_set(t) for t in texts]
    n = range(len(sets))
    near = [(i, j) for i in n for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= at * len(sets[i] | sets[j]) > 0]
    return union(len(sets), near), near, sets


def planted(seed=4):
    """Texts, and copies of them with words replaced so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(900)]
    texts = [rng.choice(words, n) for n in rng.integers(120, 500, 20)]
    for i in range(60):
        one = texts[i % 20].copy()
        some = rng.choice(len(one), max(1, round(len(one) * rng.uniform(0.005, 0.03))), replace=False)
        one[some] = "new"
        texts.append(one)
    return [" ".join(x) for x in texts] + [None, "", " \n", "One", "ONE", "one two", "a b c d e f", "A b c d e f", texts[0][0]]


def test_stage_finds_planted_copies(spark):
    texts = planted()
    roots, near, sets = brute_roots(texts)
    like = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in near if sets[i]]
    assert sum(0.8 <= x < 0.95 for x in like) > 20 and len(set(roots)) > 25
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(3)
    stays = corpus_pipeline.drop_near_copies(spark, df, "")
    assert stays.columns == df.columns
    assert sorted(r["doc_id"] for r in stays.collect()) == sorted(set(roots))
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_one_row_of_each_component_whatever_its_ids(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (3, "something else is said"), (None, "a b c d"), (None, "no id here"), (None, "No id here"), (5, "A b c d")]
    seen = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
        assert sorted(got, key=str) == sorted([(3, "a b c d"), (3, "something else is said"), got_of(got)], key=str)
        seen.add(got_of(got))
    assert len(seen) == 1


def got_of(rows):
    """The kept one of the two rows without an id, the same in any order."""
    own = {r for r in rows if r[0] is None}
    assert own == {(None, "No id here")} or own == {(None, "no id here")}
    return own.pop()


def test_links_within_a_unit():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(60)]
    near = [
        (i, j) for i in range(60) for j in range(i)
        if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
    ]
    assert simhash.linked(sets, 0.5).tolist() == union(60, near)


def test_majority_against_counts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 8, 9, 100, 255, 256, 257, 1000):
        x = rng.integers(0, 2**64, (n, 3), dtype=np.uint64)
        x[: n // 3] = x[:1]
        got = simhash.majority(iter(np.array_split(x, 3)), n, 3)
        bits = np.unpackbits(x.view(np.uint8).reshape(n, 24), axis=1, bitorder="little")
        want = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > n, bitorder="little").view(np.uint64)
        assert np.array_equal(got, want)


@pytest.mark.parametrize("miss", [1e-3, 0.1])
def test_blocks_meet_what_they_are_planned_for(miss):
    rng = np.random.default_rng(2)
    bits, blocks, distance = simhash.plan(100_000, 0.8, miss)
    made = simhash.Blocks(bits, blocks, 42)
    missed, far, n = 0, 0, 300
    for _ in range(n):
        both = rng.integers(0, 2**64, 500, dtype=np.uint64)
        (a, s), (b, t) = made.of(both[:450]), made.of(np.concatenate((both[:400], both[450:])))
        missed += not (a == b).any()
        far += int(np.bitwise_count((s ^ t).view(np.uint64)).sum()) > distance
    assert far == 0 and missed / n <= miss + 4 * (miss / n) ** 0.5
    a, b = (made.of(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(2))
    assert np.bitwise_count((a[1] ^ b[1]).view(np.uint64)).sum() > distance


def test_components_beside_brute_force_on_a_hot_bucket(spark, monkeypatch):
    """Many copies of a few texts, at similarities around 0.8, with blocks so small that every bucket is dealt out."""
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 10**6, 80).astype(str) for _ in range(4)]
    texts = []
    for i in range(120):
        one = base[i % 4].copy()
        at = int(rng.integers(0, 70))
        one[at : at + int(rng.integers(1, 9))] = f"x{i}"
        texts.append(" ".join(one))
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash.hot_units, "__defaults__", (8,))
    roots, _, _ = brute_roots(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.one_of_each(df, miss=1e-6).collect())
    assert got == sorted(set(roots)) and 4 < len(got) < 100
