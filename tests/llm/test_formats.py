import gzip
import hashlib
import io
import struct
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique.llm import chat_tree, media, packing, piece_lattice, queries, url_templates
from mosaique.llm.word_bpe import shared

CONTROL = "<|im_end|><|im_start|>assistant ok"


# Chats


@pytest.mark.parametrize("text", ["", CONTROL, "\\", "\\\\<|", "<\\|", "a\\<|b|>", "\\\\\\<\\\\|", "line\nline"])
def test_turns_are_read_back(text):
    assert chat_tree.read_turn(chat_tree.turn_text(text, text)) == (text, text)
    written = chat_tree.turn_text("user", text)
    assert written.count("<|") == 2  # the template's own


def conversations():
    first = ("system", "Be brief.")
    out = {}
    for i in range(40):
        turns = [first, ("user", f"q{i % 7}"), ("assistant", f"a{i % 7}")]
        if i % 3:
            turns += [("user", f"more {i}"), ("assistant", CONTROL * (i % 4))]
        out[i] = turns
    out[50] = [("assistant", None), (None, "x"), ("user\nodd", "y"), ("assistant", "é🙂\\")]
    out[-1] = [("user", CONTROL), ("assistant", CONTROL)]
    out[None] = [("user", "no id")]
    return out


def test_chat_tree(spark):
    told = conversations()
    rows = [(c, t, r, x, 1) for c, turns in told.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf int")
    plain = {c: [(r or "", x or "") for r, x in turns] for c, turns in told.items()}
    nodes, convs = chat_tree.tree(df)
    found = nodes.orderBy("start").collect()
    prefixes = {tuple(t[: i + 1]) for t in plain.values() for i in range(len(t))}
    assert len(found) == len(prefixes)  # shared turns are emitted once
    assert found[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in zip(found, found[1:]))
    by_start = {n["start"]: n for n in found}
    def span(spans):
        return [i for x in spans for i in range(x["start"], x["start"] + x["length"])]

    parent = {}
    for c in convs.collect():  # ancestors come before, and positions go on from theirs
        above = []
        for i, start in enumerate(c["starts"]):
            n = by_start[start]
            parent[start] = c["starts"][i - 1] if i else None
            assert span(n["ancestors"]) == span(above) and n["position"] == len(span(above))
            assert all(x["start"] + x["length"] < y["start"] for x, y in zip(n["ancestors"], n["ancestors"][1:]))
            above.append(n)
        assert span(c["intervals"]) == span(above) and len(c["starts"]) == len(plain[c["conv_id"]])
    stack = []
    for n in found:  # depth-first
        while stack and stack[-1] != parent[n["start"]]:
            stack.pop()
        assert bool(stack) == (parent[n["start"]] is not None)
        stack.append(n["start"])
    got = {r["conv_id"]: r for r in chat_tree.digest(df).collect()}
    assert set(got) == set(plain)
    for c, turns in plain.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat_tree.turn_text(a, b)) for a, b in turns)
    assert chat_tree.digest(df.limit(0)).count() == 0


def test_long_and_repeated_conversations(spark, monkeypatch):
    """A conversation of many turns has few intervals; one that most rows are copies of is dealt out."""
    monkeypatch.setattr(chat_tree, "HOT", 4)
    monkeypatch.setattr(chat_tree, "SPLIT", 3)
    long_one = [(0, t, "user", f"turn {t} " + "x" * (40_000 if t == 7 else 3), "y") for t in range(300)]
    copies = [(i, t, r, "same", "y") for i in range(1, 60) for t, r in enumerate(["user", "assistant"])]
    repeated = [(100, 0, "user", "again", "y")] * 2 + [(None, None, None, None, "y"), (101, None, "user", "", "y")]
    df = spark.createDataFrame(long_one + copies + repeated, "conv_id long, turn long, role string, text string, starts string")
    nodes, convs = chat_tree.tree(df)
    sizes = [len(n["ancestors"]) for n in nodes.collect()]
    assert len(sizes) > 300 and max(sizes) <= 2
    got = {r["conv_id"]: r for r in chat_tree.digest(df).collect()}
    assert set(got) == {0, *range(1, 60), 100, 101, None} and got[0]["n_turns"] == 300 and got[100]["n_turns"] == 2
    assert len({r["turns_sha256"] for c, r in got.items() if c and c < 60}) == 1
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\nsame\nassistant\nsame\n").hexdigest() and got[5]["loss_chars"] == 4
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()


def test_what_partitions_share_is_emitted_once():
    """Partition ends put the pieces of a tree that spans partitions together."""
    h = lambda *xs: b"".join(bytes([x]) * chat_tree.HASH for x in xs)
    ends = [
        {"part": 0, "first": h(1, 2), "first_sizes": [5, 3], "last": h(1, 4), "starts": [0, 8], "sizes": [5, 2], "total": 10},
        {"part": 1, "first": h(1, 4, 5), "first_sizes": [5, 2, 1], "last": h(1, 4, 6), "starts": [0, 5, 8], "sizes": [5, 2, 4], "total": 12},
        {"part": 2, "first": h(1, 7), "first_sizes": [5, 9], "last": h(1, 7), "starts": [0, 5], "sizes": [5, 9], "total": 14},
    ]
    got = chat_tree._begins(ends)
    assert got[0] == (0, 0, [])
    assert got[1] == (10, 2, [(0, 5), (8, 2)])
    assert got[2] == (15, 1, [(0, 5)])


# Media


def gif():
    return b"GIF89a" + b"\x02\x00\x03\x00\x80\x00\x00" + b"\0" * 6 + b"\x2c" + b"\0" * 9 + b"\x02\x02\x4c\x01\x00\x3b"


def test_media_round_trip_and_types():
    for i in range(12):
        payload = bytes([i]) * (media.UNIT * (i + 1))
        content = media.encode(payload)
        own, inner = media.judge(content)
        assert own[0] in (media.PNG, media.BMP, media.WAV) and own[1] == len(content) and inner == []
        assert media.decode(content, own[0]) == payload
    assert {media.judge(media.encode(bytes([i]) * 192))[0][0] for i in range(12)} == {media.PNG, media.BMP, media.WAV}


def test_validators_refuse_what_is_not_whole():
    for i in range(12):
        content = media.encode(bytes([i]) * 384)
        assert media.judge(content[:-1])[0] is None
    png = next(c for c in (media.encode(bytes([i]) * 192) for i in range(20)) if c[:4] == b"\x89PNG")
    assert media.judge(png[:40] + b"x" + png[41:])[0] is None  # a wrong checksum
    assert media.judge(None) == (None, []) and media.judge(b"") == (None, [])
    assert media.judge(b"BM and RIFF and GIF89a and PK\x03\x04 %PDF-1.4 II*\x00 \xff\xd8\xff ftyp OggS fLaC") == (None, [])


def test_carving(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    files = [gzip.compress(b"x" * 1000), z.getvalue(), gif(), media.encode(b"q" * 192)]
    blob, at = b"text ", []
    for f in files:
        at.append(len(blob))
        blob += f + b" more "
    own, inner = media.judge(blob)
    assert own is None and [(a, x[1]) for a, x in inner] == [(a, len(f)) for a, f in zip(at, files)]
    df = spark.createDataFrame([(1, "image/png", bytearray(blob)), (2, "image/png", bytearray(gif())), (3, None, None)], "id long, declared string, content binary")
    got = {r["id"]: r["sniffed"] for r in media.sniff(df).collect()}
    assert got[1]["type"] is None and got[2]["type"] == "image/gif" and got[3]["embedded"] == []
    carved = sorted((r["offset"], bytes(r["bytes"])) for r in media.carve(df).collect())
    assert carved == sorted(zip(at, files))


def pdf(body=b"text", updates=0):
    """A file with a table of its own, and so many updates appended."""
    out = b"%PDF-1.4\n1 0 obj\n" + body + b"\nendobj\n"
    for _ in range(updates + 1):
        at = len(out)
        out += b"xref\n0 1\n0000000000 65535 f\ntrailer <<>>\nstartxref\n%d\n%%%%EOF\n" % at
    return out[:-1]


def tiff(pixels=b"p" * 50):
    entries = [(256, 3, 1, 5), (257, 3, 1, 10), (273, 4, 1, 8 + 2 + 48 + 4), (279, 4, 1, len(pixels))]
    ifd = struct.pack("<H", 4) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + ifd + pixels


def zipped(name, data):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr(name, data)
    return z.getvalue()


def test_whole_files_to_their_real_ends():
    inner = zipped("a.txt", "hello")
    nested = zipped("b.zip", inner)
    small = media.encode(b"q" * 192)
    for f in (pdf(), pdf(updates=2), pdf(pdf(b"inner", 1), 1), nested, tiff()):
        own, _ = media.judge(f + b" more")
        assert own is not None and own[1] == len(f)
        assert [(at, x[1]) for at, x in media.judge(b"text " + f + b" more")[1]][0] == (5, len(f))
    assert (nested.index(inner), len(inner)) in [(at, x[1]) for at, x in media.judge(nested)[1]]
    assert media.judge(b"says %PDF-1.4 and then %%EOF")[1] == []
    assert media.judge(pdf()[:-30] + b"startxref\n7\n%%EOF")[0] is None
    both = pdf(b"a") + b" and " + pdf(b"b", 1)
    assert [x[1] for _, x in media.finds(both)] == [len(pdf(b"a")), len(pdf(b"b", 1))]
    bmp = next(c for c in (media.encode(bytes([i]) * 192) for i in range(20)) if c[:2] == b"BM")
    outer = next(c for c in (media.encode((bytes([i]) * 6 + bmp).ljust(384)) for i in range(60)) if c[:2] == b"BM")
    assert [x[1] for _, x in media.judge(outer)[1]] == [len(bmp)]  # of its own family
    assert small and len(media.finds(outer)) == 2


def test_long_texts_of_headers_take_linear_time():
    import time

    for unit in (b"%PDF-1.4 ", b"PK\x03\x04", b"%PDF-1.4 startxref\n9\n%%EOF ", b"PK\x03\x04PK\x05\x06" + bytes(18)):
        start = time.perf_counter()
        media.finds(unit * (2_000_000 // len(unit)))
        assert time.perf_counter() - start < 8


def test_media_digest(spark):
    texts = [None, "", "é" * 96, "a" * 192, "b" * 193, "BM %PDF-1.4 %%EOF", "x" * 400_000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "a" * 192, "c"), (3, "a" * 192, "c")], "doc_id long, text string, content string")
    rows = media.digest(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        raw = (texts[3 if r["doc_id"] is None else r["doc_id"]] or "").encode()
        pay = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(pay), zlib.crc32(pay[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(pay).hexdigest()
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] in (None, 3)}) == 1  # equal texts, equal values
    assert media.digest(df.limit(0)).count() == 0


# Urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/1", "https://example.net/EN/1", "https://net/", "https://net",
    "https://xnet/de/", "https://m.example.com/de/4?x", "https://example.com/de", "https://É.org/fr/#a", "x://a.org?/fr/", "y://org/fr/a?b#c", "z://://a/b",
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits, key=len) if fits else None


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], "h"), (4, URLS[4], "h")], "page_id long, url string, host string")
    rows = url_templates.judge(df, RULES).collect()
    assert len(rows) == df.count()
    for r in rows:
        host, path, rule = brute_rule(URLS[4 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == RULES[rule] if rule else r["verdict"] in ("allow", "block")
    assert url_templates.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_templates.judge(df, {}).collect()} == {"allow"}


def test_templates_generalise_merge_and_reject(spark):
    rows = [("a.com", f"/item/{i}", 1) for i in range(30)] + [("a.com", f"/item/{i}", None) for i in range(30, 60)]
    rows += [("a.com", f"/user/name{chr(97 + i)}{chr(98 + i)}", 0) for i in range(20)]
    rows += [("b.com", f"/{lang}/{i}.html", 0) for lang in ("en", "fr") for i in range(9)] + [("b.com", "/x", None), ("b.com", "", None), ("b.com", "/", None)]
    rows += [("c.com", "/" + "/".join("abcdefghijkl"), None)]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    got = {(r["host"], r["template"]): r["purity"] for r in url_templates.templates(df, max_children=10, min_share=0.2).collect()}
    assert got[("a.com", "/item/#")] > 0.5 > got[("a.com", "/user/*")]
    assert ("b.com", "/(en|+1)/#.html") in got
    assert ("c.com", "/" + "/".join("abcdefghijkl")) in got  # no deep path is cut


def brute_verdicts(urls, rules, purity=0.5, max_children=16, min_share=0.02, weight=4.0, depth=8):
    """(rule, verdict, purity) of each url, by trees of dictionaries."""
    import math
    from collections import Counter, defaultdict
    from decimal import ROUND_HALF_UP, Decimal

    rows, shapes = [], {}
    for url in urls:
        host, path, rule = brute_rule(url)
        plain = re.sub(r"(?i)(?=[a-f-]*[0-9])[0-9a-f]{8,}(-[0-9a-f]{4,})*", "#", path)
        parts = re.sub("[0-9]+", "#", plain).split("/")[1:]
        shape = tuple(parts[:depth] + ["/".join(parts[depth:])] if len(parts) > depth else parts)
        rows.append((host, shape, rule))
        x = shapes.setdefault((host, shape), [0, 0, 0])
        x[0] += 1
        x[1] += rule is not None
        x[2] += rule is not None and rules[rule] == "block"
    segs = {k: k[1] for k in shapes}
    for d in range(depth + 1):
        kids = defaultdict(Counter)
        for (h, sh), s in segs.items():
            if len(s) > d:
                kids[h, s[:d]][s[d]] += shapes[h, sh][0]
        rare = {(p, c) for p, k in kids.items() if len(k) > max_children for c, n in k.items() if n < min_share * sum(k.values())}
        segs = {k: s[:d] + ("*",) + s[d + 1 :] if len(s) > d and ((k[0], s[:d]), s[d]) in rare else s for k, s in segs.items()}
    for d in range(max(map(len, segs.values()), default=0) - 1, -1, -1):
        nodes = {}
        for k, s in segs.items():
            if len(s) > d:
                x = nodes.setdefault((k[0], s[:d], s[d]), [set(), 0, 0, 0])
                x[0].add(s[d + 1 :])
                for i in range(3):
                    x[i + 1] += shapes[k][i]
        told = defaultdict(lambda: [0, 0])
        for (h, parent, _), (_, _, labelled, blocked) in nodes.items():
            told[h, parent][0] += labelled
            told[h, parent][1] += blocked
        groups = defaultdict(list)
        for (h, parent, seg), (forms, n, labelled, blocked) in nodes.items():
            most, bad = told[h, parent]
            share = blocked / labelled if labelled else bad / most if most else 0.0
            width = float(Decimal(repr(min(0.5, max(0.05, 1 / math.sqrt(n))))).quantize(Decimal("0.01"), ROUND_HALF_UP))
            rate = math.floor(math.asin(math.sqrt(share)) / width + 0.5) * width
            groups[h, parent, frozenset(forms), rate].append(seg)
        names = {(h, p, seg): f"({min(g)}|+{len(g) - 1})" for (h, p, _, _), g in groups.items() if len(g) > 1 for seg in g}
        segs = {k: s[:d] + (names.get((k[0], s[:d], s[d]), s[d]),) + s[d + 1 :] if len(s) > d else s for k, s in segs.items()}
    labelled, blocked = (sum(x[i] for x in shapes.values()) for i in (1, 2))
    prior = min(blocked / max(1, labelled), math.nextafter(purity, 0))

    def chain(host):
        names = host.split(".")
        if len(names) <= 2 or re.search(r"^[0-9.]+$|[:\]]", host):
            return [host]
        return [".".join(names[-k:]) for k in range(2, len(names) + 1)]

    domain, branch = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for k, s in segs.items():
        for at in [("d", x) for x in chain(k[0])] + [("b", k[0], s[:i]) for i in range(1, len(s) + 1)]:
            x = (domain if at[0] == "d" else branch)[at]
            x[0] += shapes[k][1]
            x[1] += shapes[k][2]
    out = []
    for host, shape, rule in rows:
        if rule is not None:
            out.append((rule, rules[rule], None))
            continue
        s, p = segs[host, shape], prior
        for n, bad in [domain["d", x] for x in chain(host)] + [branch["b", host, s[:i]] for i in range(1, len(s) + 1)]:
            p = (bad + weight * p) / (n + weight) if n else p
        out.append((None, "block" if p >= purity else "allow", p))
    return out


def test_op7_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()
    want = brute_verdicts([r["url"] for r in pages], queries.URL_RULES)
    got = {r["page_id"]: r for r in queries.op7_url_templates(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == len(pages)
    for r, (rule, verdict, p) in zip(pages, want):
        x = got[r["page_id"]]
        assert (x["rule"], x["verdict"]) == (rule, verdict) and x["purity"] == (None if p is None else pytest.approx(p))
    free = [w for w in want if w[0] is None]
    assert len({v for _, v, _ in free}) == 2 and len({p for _, _, p in free}) > 3


def test_urls_of_any_kind(spark):
    """Very long urls, ties, repeated and null ids, and an extra column of a clashing name."""
    urls = [None, "", "http://h.com/" + "a/" * 5000 + "1", "http://h.com/" + "a/" * 5000 + "b1c", "http://h.com/" + "q" * 200_000]
    urls += [f"http://h.com/{c}/{i}" for c in "xy" for i in range(3)] * 2
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 7, u, "s") for i, u in enumerate(urls)], "page_id long, url string, shape string")
    got = sorted((str(r["page_id"]), r["verdict"], r["purity"]) for r in url_templates.judge(df, RULES).collect())
    want = brute_verdicts(urls, RULES)
    assert got == [(a, b, pytest.approx(c)) for a, b, c in sorted((str(None if i % 5 == 0 else i % 7), v, p) for i, (_, v, p) in enumerate(want))]
    assert url_templates.judge(df.limit(0), RULES).count() == 0


def test_labels_reach_pages_without_a_rule(spark):
    rules = {"bad.com/x/": "block", "good.com/x/": "allow", "mixed.com/x/": "block", "mixed.com/y/": "allow", "far.org/x/": "block"}
    urls = [f"http://{h}/{s}/{i}" for h in ("a.bad.com", "good.com", "mixed.com") for s in "xyz" for i in range(10)]
    urls += ["http://b.bad.com/", "http://b.bad.com/q/7", "http://elsewhere.net/x/1", "http://1.2.3.4/x"]
    urls += [f"http://www.far.org/x/{i}" for i in range(100)]  # blocked share of all labelled pages: over 0.5
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = [r for r in url_templates.judge(df, rules).collect() if r["rule"] is None]
    got = {h: {r["verdict"] for r in rows if r["host"] == h} for h in {r["host"] for r in rows}}
    assert got["a.bad.com"] == {"block"}  # its own labels
    assert got["b.bad.com"] == {"block"}  # those of the parent domain
    assert got["good.com"] == {"allow"}
    assert got["elsewhere.net"] == got["1.2.3.4"] == {"allow"}  # no label but the table's share
    purity = {r["host"]: r["purity"] for r in rows}
    assert purity["a.bad.com"] > 0.8 and purity["good.com"] < 0.2 and 0.3 < purity["mixed.com"] < 0.7


def test_op7_starts_few_jobs(spark):
    """Each job and each stage's new plan costs the driver memory; nodes with few children need none to rewrite them."""
    urls = [f"http://{h}.com/{a}/{b}/{i}" for i, (h, a, b) in enumerate((h, a, b) for h in "pq" for a in "xyz" for b in "uv")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    spark.sparkContext.setJobGroup("op7-jobs", "op7")
    try:
        rows = url_templates.judge(df, RULES).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["page_id"] for r in rows) == list(range(12))
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("op7-jobs")) <= 50


# Packing


def brute_cost(pos, penalty, size):
    best = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            if pos[j] - pos[i] <= size:
                best[j] = min(best[j], best[i] + penalty[j] + size - (pos[j] - pos[i]))
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pos = np.concatenate(([0], np.cumsum(rng.integers(1, 9, rng.integers(1, 40)))))
        penalty = rng.choice([0.0, 3.0, 7.0], len(pos))
        cuts = packing.best_cuts(pos, penalty, 16)
        widths = np.diff(pos[cuts])
        assert cuts[0] == 0 and cuts[-1] == len(pos) - 1 and widths.max() <= 16
        assert (16 - widths).sum() + penalty[cuts[1:]].sum() == pytest.approx(brute_cost(pos, penalty, 16))


@pytest.mark.parametrize("size", [1, 2, 7, 16, 63])
def test_windows_of_any_size(size):
    rng = np.random.default_rng(5)
    ends = rng.random(100) < 0.02
    packer = packing.Packer(ends, size, 8.0, 16.0, 0)
    docs = [rng.integers(0, 100, n).astype("<u4") for n in (1, 300, 2, 90, 1)] * 2  # an id may repeat
    rows = [r for i, d in enumerate(docs) for r in packer.add(i % 5, d)] + packer.pack(True)
    assert sum(r[2] for r in rows) == sum(map(len, docs))
    lengths = {}
    for r in rows:
        lengths[r[5]] = lengths.get(r[5], 0) + r[2]
    assert max(lengths.values()) <= size


PACKED = [None, "", "One. Two! Three?", "word " * 20_000, "ünïcode ß ſ İ 日本 <|endoftext|>", "a | b | c " * 400, "it's\x01 'd", "END. " * 3]


def test_pieces_hold_every_id_once(spark):
    bpe = shared()
    rows = [(i, t, 1) for i, t in enumerate(PACKED * 3)] + [(None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = packing.pack(df, size=512).collect()
    want = {i: np.append(bpe.whole(t or ""), np.uint32(2)).astype("<u4") for i, t, _ in rows}
    docs, sequences = {}, {}
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(docs) == set(want)
    for d, pieces in docs.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(want[d])
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [t or "" for t in PACKED] + ["don't we'll  x '!s '' ''s", "²½ a’b ﬁ", "L'été: \x85 'S'D", " a\n\n b \xa0c "])
def test_ids_are_the_tokenizers(text):
    assert shared().ids(text).tolist() == shared().whole(text).tolist()


# Pieces

TRICKY = [None, "", " ", "  a  b ", "x\n\n  y", "日本語 テスト", "🙂🙂 a", "0x1F\t", "Hello there, this is a sentence.", "q" * 3000, "trailing ", "<s> </s> <unk> <0x41>"]


def test_pieces_against_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.default_path())
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(TRICKY * 2)] + [(None, "a b", "w")], "doc_id long, text string, word string")
    for frequent in (0, 1000):  # all by tasks, or the common ones by the lattice
        encoded = piece_lattice.encode(df, frequent=frequent)
        got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
        assert got == {**{i: sp.encode(t or "") for i, t in enumerate(TRICKY * 2)}, None: sp.encode("a b")}
        back = {r["doc_id"]: r["text"] for r in piece_lattice.decode(encoded).collect()}
        assert back == {**{i: t or "" for i, t in enumerate(TRICKY * 2)}, None: "a b"}
    rows = piece_lattice.digest(df).collect()
    for r in rows:
        ids = np.array(sp.encode((TRICKY * 2)[r["doc_id"]] or "" if r["doc_id"] is not None else "a b"), "<u4")
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert piece_lattice.encode(df.limit(0)).count() == 0


def test_folds_of_the_lattice(spark):
    pieces = piece_lattice.Pieces.load()
    words = ["▁hello", "▁▁▁", "▁the", "日本", "x", "▁under­stand", "aaaaaaa", "▁q🙂"]
    df = spark.createDataFrame([(w,) for w in words * 2], "word string")
    got = {r["word"]: list(r["ids"]) for r in piece_lattice.encode_words(df, pieces).collect()}
    assert got == {w: pieces.ids(w) for w in words}


def test_both_folds_give_the_same_ids(spark):
    """Words of the corpus by the relational lattice and by the tasks' arrays."""
    pieces = piece_lattice.Pieces.load()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).where("length(w) BETWEEN 1 AND 40").select(F.concat(F.lit("▁"), "w").alias("word"))
    got = {r["word"]: list(r["ids"]) for r in piece_lattice.encode_words(words, pieces).collect()}
    names = list(got)
    n, ids = piece_lattice.Folder(pieces).fold(names)
    ends = np.cumsum(n)
    assert len(names) > 3000 and all(got[w] == ids[e - k : e].tolist() for w, k, e in zip(names, n, ends))
    repeated = spark.createDataFrame([(1, "the word"), (1, "the word"), (None, None), (1, "")], "doc_id long, text string")
    assert sorted(r["n_pieces"] for r in piece_lattice.digest(repeated, frequent=1).collect())[:2] == [0, 0]


def brute_best(word, scores, floor):
    if not word:
        return 0.0
    best = floor + brute_best(word[1:], scores, floor) if word[0] not in scores else -1e9
    for k in range(1, len(word) + 1):
        if word[:k] in scores:
            best = max(best, scores[word[:k]][0] + brute_best(word[k:], scores, floor))
    return best


def test_viterbi_against_brute_force(spark):
    rng = np.random.default_rng(0)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "aab", "cc"]
    scores = {p: (-float(rng.integers(1, 90)) / 8, i + 300) for i, p in enumerate(names)}
    pieces = piece_lattice.Pieces(scores, tuple(range(256)), 999, "unigram")
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(40)]
    got = {r["word"]: list(r["ids"]) for r in piece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    floor = min(s for s, _ in scores.values()) - piece_lattice.UNKNOWN
    by_id = {i: s for s, i in scores.values()}
    for w in set(words):
        total = sum(by_id.get(i, floor) for i in got[w])
        assert total == pytest.approx(brute_best(w, scores, floor))
        assert sum(by_id.get(i, floor) for i in pieces.ids(w)) == pytest.approx(total)
