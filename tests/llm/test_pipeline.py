import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from mosaique.llm import packing, quality, toxicity
from mosaique.llm.common import held_out
from mosaique.llm.word_bpe import shared
from tests.llm.test_near_copies import brute_roots
from tests.llm.test_near_dedup import brute_lines

SF = "/root/testdata/sf0.001"


def test_names():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark, stages):
    docs, clean, good, lines, distinct, packed = stages
    assert all(x.columns == docs.columns for x in stages[:5])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # toxicity and quality: the same models, text by text
    model = toxicity.fit(docs, labels, held_out("doc_id", 5, 0))
    want = {i for i, r in rows(docs).items() if model.score(*model.measure(r["text"])[:2]) < 0.5}
    assert set(rows(clean)) == want
    model, features = quality.fit(clean, labels, held_out("doc_id", 4, 2)), quality.Features()
    want = {i for i, r in rows(clean).items() if model.score(*features.of(r["text"], r["n_chars"])) >= 0.7}
    assert set(rows(good)) == want
    # line dedup
    kept = {i: t for i, t, _, _ in brute_lines([(i, r["text"]) for i, r in rows(good).items()])}
    assert {i: r["text"] for i, r in rows(lines).items()} == kept
    assert all(len(r["text"]) == r["n_chars"] for r in rows(lines).values())
    # near copies
    ids = sorted(rows(lines))
    roots, _, _ = brute_roots([kept[i] for i in ids])
    assert sorted(rows(distinct)) == sorted({ids[r] for r in roots})
    # packing holds every id of what is left
    left = {}
    for r in packed.collect():
        left.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(left) == set(rows(distinct))
    for i, pieces in left.items():
        own = np.append(shared().whole(kept[i]), np.uint32(2)).astype("<u4")
        assert sum(n for _, n, _ in pieces) == len(own)
        assert all(zlib.crc32(own[a : a + n].tobytes()) == c for a, n, c in pieces)


def test_little_padding(stages):
    n = {}
    for r in packing.pack(stages[0].coalesce(1)).collect():
        n[r["sequence_id"]] = n.get(r["sequence_id"], 0) + r["length"]
    # one window more than needed for the end of the only partition, and little else
    assert len(n) <= 1.01 * sum(n.values()) / 4096 + 1


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted({r["doc_id"] for r in got.select("doc_id").collect()}) == sorted(rows(stages[4]))


def test_stages_of_nothing(spark, stages):
    rows_of = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows_of = stage(spark, rows_of, SF)
        assert rows_of.count() == 0


def test_stages_take_rows_of_any_kind(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns of clashing names."""
    own = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long_text = " ".join(f"word{i % 997} of a long text." for i in range(60_000))
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (7, None, None, "web", None), (9001, long_text, "en", "web", None)]
    odd += [own[0], own[0], (own[1][0], "Another text under an id that is taken.\nA line that three documents share.", None, None, 3)]
    odd += [(9002 + i, f"A line that three documents share.\nown {i}", "en", "web", None) for i in range(3)] + [(None, own[2][1], "en", "web", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, d string, ck string, node long, words string, score double"
    docs = spark.createDataFrame([(*r, i % 3, "d", None, 4, "w", 0.5) for i, r in enumerate(own + odd)], schema).repartition(3)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        n, m = before.count(), after.count()
        assert 0 < m <= n and (m == n or name != "line_dedup"), name
        if name != "line_dedup":  # rows pass unchanged
            assert after.exceptAll(before).count() == 0, name
        before = after if name != "quality" else docs  # that stage refuses odd texts, which the others are to see
    texts = [r["text"] for r in before.collect()]
    roots, _, _ = brute_roots([t if t is None or len(t) < 10**6 else "long" for t in texts])
    assert len(set(roots)) == len(texts)  # no two of what is left are near copies
    packed = corpus_pipeline.pack(spark, before, SF).collect()
    want = sum(len(shared().whole(t or "")) + 1 for t in texts)
    assert sum(r["length"] for r in packed) == want
