import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaique.llm import embedding_dedup, line_dedup, simhash
from mosaique.llm.common import bucket_units, components, in_units, labels_of


def union(n, links):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = rng.integers(0, 60, (45, 2)).tolist() + [[i, i + 1] for i in range(100, 140)]
    df = spark.createDataFrame([tuple(x) for x in links], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = union(200, links)
    assert all(want[k] == v for k, v in got.items())
    assert {x for a, b in links if a != b for x in (a, b)} == set(got)
    assert components(df.limit(0)).count() == 0
    a, b = np.array(links).T
    assert labels_of(200, a, b).tolist() == want


def test_units_cover_all_pairs_of_a_hot_bucket_once(spark):
    rows = spark.range(50).select(F.lit(0).alias("t"), F.lit(5).alias("key"), F.col("id").alias("node"))
    rows = rows.unionByName(spark.createDataFrame([(0, 6, 99)], "t int, key int, node long"))  # alone in its bucket
    units = bucket_units(rows, ["t", "key"], "node", block=8)
    assert units.where("node = 99").count() == 0

    def work(unit):
        import pandas as pd

        n, blk = unit["node"].tolist(), unit["blk"].tolist()
        lo, hi = unit["lo"].iloc[0], unit["hi"].iloc[0]
        pairs = [
            (min(n[i], n[j]), max(n[i], n[j]), len(n))
            for i in range(len(n)) for j in range(i)
            if lo == hi or blk[i] != blk[j]
        ]
        return pd.DataFrame(pairs, columns=["a", "b", "size"]) if pairs else None

    got = in_units(units, ["t", "key"], work, "a long, b long, size long").collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a in range(50) for b in range(a + 1, 50)]
    assert max(r["size"] for r in got) < 40


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    rows = [b for b in base]
    rows += [base[i % 3] + rng.normal(size=16) * 0.05 for i in range(60)]  # near copies
    rows += [base[5]] * 7 + [base[6] * 3.0]  # exact copies, and one of another length
    rows = [r.astype(float).tolist() for r in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [1.0] * 15, [1.0] * 4, [1.0] * 4]
    return [(i, r) for i, r in enumerate(rows + odd)]


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, w int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    unit = [embedding_dedup._unit(v) for _, v in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    ]
    roots = union(len(rows), links)
    for i, _ in rows:
        assert got[i]["n_links"] == sum(i in x for x in links)
        assert got[i]["component_id"] == roots[i]
        assert got[i]["kept"] == (roots[i] == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.001]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 0, None, True)], key=str)


def test_tables_meet_the_recall_they_are_planned_for():
    rng = np.random.default_rng(0)
    k, tables = embedding_dedup.plan(10_000, 0.95, 2.4, 0.01)
    h = embedding_dedup.Hashes(k, tables, 2.4, 20)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b  # pairs right at the threshold
    assert (h.keys(a) == h.keys(b)).any(axis=1).mean() > 0.97


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


TEXTS = [None, "", "  \n\t", "One", "ONE", "one two", "a b c", "a b c a b c", "É é \x1c x\x0by", "x " * 70_000, "Ünïcode Text here now"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [" ".join(rng.choice(vocabulary, 400)) for _ in range(12)]
    docs += [docs[i % 4].replace(" w1 ", " W1 ").replace(f" w{i} ", " zz ", 1) for i in range(40)]
    rows = list(enumerate(docs + [t for t in TEXTS if t is None or len(t) < 1000]))
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, fp string, low int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fp = np.array([brute_fingerprint(t) for _, t in rows], dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2, 1)).tolist()
    roots = union(len(rows), near)
    assert len(near) > 20
    for i, _ in rows:
        assert got[i]["fingerprint"] == f"{int(fp[i]):016x}" and got[i]["component_id"] == roots[i]


def test_simhash_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words stand here")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each(df).collect()) == ["3", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def test_pigeonhole_masks_find_every_close_pair():
    masks = [m & (2**64 - 1) for m in simhash.block_masks(4, 2)]
    assert len(masks) == 6
    for i in range(64):
        for j in range(i, 64):
            x = (1 << i) | (1 << j)
            assert any(x & m == 0 for m in masks)


LINES = [
    (1, "Shared line of text, long enough\nown one\n  SHARED LINE of text, long ENOUGH\t\nshort"),
    (2, "shared line of text, long enough\nÉCOLE ÉCOLE ÉCOLE ÉCOLE ÉCOLE"),
    (3, "x\nshared line of text, long enough \x0b\nécole école école école école"),
    (4, None), (5, ""), (6, "\n\n"), (7, "İİİİİİİİİİİİİİİİİİİİ\nécole école école école école\x0c"),
    (8, " shared line of text, long enough"), (9, "y" * 300_000 + "\nécole école école école école"), (10, "y" * 300_000),
    (11, "Y" * 300_000), (11, "Y" * 300_000), (12, "twenty code points é\nTWENTY CODE POINTS é"), (13, "twenty code points é"), (14, "Twenty code points é\r"),
]


def brute_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i != max(held[key(x)]) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_against_brute_force(spark, monkeypatch, hot):
    import hashlib

    df = spark.createDataFrame([(i, t, 5, "z") for i, t in LINES], "doc_id long, text string, n_chars long, words string")
    if hot:  # all keys are dealt by document as well
        keys = [r["h1"] for r in line_dedup._long_lines(df, 20).select("h1").distinct().collect()]
        monkeypatch.setattr(line_dedup, "_hot_keys", lambda lines: keys)
    want = brute_lines(LINES)
    got = sorted((tuple(r) for r in line_dedup.digest(df).collect()), key=str)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in want), key=str)
    kept = line_dedup.drop_lines(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted(((i, t) for i, t, _, _ in want), key=str)
    assert all(r["n_chars"] in (5, len(r["text"] or "")) for r in kept.collect())


def test_line_dedup_without_rows_or_ids(spark):
    df = spark.createDataFrame([(None, "a line that is long enough here")] * 2 + [(1, "a line that is long enough here")], "doc_id long, text string")
    assert [r["n_dropped"] for r in line_dedup.digest(df).collect()] == [0, 0, 0]  # two documents
    more = df.unionByName(df.select((F.coalesce("doc_id", F.lit(1)) + 1).alias("doc_id"), "text"))
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.digest(more).collect()}
    assert got == {None: 1, 1: 1, 2: 0}
    assert line_dedup.digest(df.limit(0)).count() == 0
