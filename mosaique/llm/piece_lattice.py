"""SentencePiece encoding and decoding by a relational lattice.

A text's spaces become ``▁``, one is put before it, and it is cut into words:
runs of ``▁`` with what follows them, which no piece of the table crosses. For a
table of words, all substrings of at most the longest piece's length are
exploded and equi-joined with the piece table; the edges found are grouped by
word, without another exchange, and folded with ``F.aggregate``:

* ``unigram`` tables by Viterbi: the best-scoring path to each place, in order;
* ``bpe`` tables by priority: while there is one, the best-scoring edge that
  covers exactly two neighbouring symbols joins them, the leftmost of equals.

SentencePiece reads a BPE model that way; a Viterbi path over its scores is a
different segmentation. Characters outside the table fall back to their bytes.

The words of the corpus are counted, the ``frequent`` most common go through the
lattice, and their ids, bounded by that number, are broadcast. A word that is
rarer or longer than ``LONGEST`` gets its lattice where it stands: the same
edges, the same fold, in the task, as arrays over the distinct words of a chunk.

Rows: a null or empty text has no ids and decodes to ''. Null and repeated
doc_ids keep their rows. An empty table gives an empty result. Texts that hold
``▁`` itself decode with a space there, as SentencePiece does. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaique.operators.graph import cut

SPACE = "▁"
#: Characters of a word that is folded by SQL at most.
LONGEST = 48
#: Score of a character outside the table, below any piece's, in a Viterbi path.
UNKNOWN = 10.0
#: Characters of the texts that a task turns into one batch.
CHUNK = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """A piece table: ids and scores by piece, ids of the 256 bytes, and how it is folded."""

    scores: dict[str, tuple[float, int]]
    byte_ids: tuple[int, ...]
    unknown_id: int
    kind: str  # "bpe" or "unigram"

    @classmethod
    def load(cls, path: str | None = None) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        path = path or default_path()
        sp = SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = sp.vocab_size()
        own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        kind = "bpe" if model.trainer_spec.model_type == 2 else "unigram"
        return cls({sp.id_to_piece(i): (sp.get_score(i), i) for i in own}, byte_ids, sp.unk_id(), kind)

    @property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, i, s) for p, (s, i) in self.scores.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double")

    def char_ids(self, c: str) -> list[int]:
        if c in self.scores:
            return [self.scores[c][1]]
        ids = [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return ids if self.unknown_id not in ids else [self.unknown_id]

    def ids(self, word: str) -> list[int]:
        """The word's ids by the same lattice, in the task."""
        if self.kind == "unigram":
            return self._viterbi(word)
        if "_folder" not in self.__dict__:
            object.__setattr__(self, "_folder", Folder(self))
        return self.__dict__["_folder"].fold([word])[1].tolist()

    def _viterbi(self, word: str) -> list[int]:
        n, floor = len(word), min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, n + 1):
            found = [(best[e - 1][0] + floor, e - 1)] if word[e - 1] not in self.scores else []
            for s in range(max(0, e - self.longest), e):
                if x := self.scores.get(word[s:e]):
                    found.append((best[s][0] + x[0], s))
            best.append(max(found))
        cuts = [n]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        cuts = cuts[::-1]
        return [
            i
            for s, e in zip(cuts, cuts[1:])
            for i in ([self.scores[word[s:e]][1]] if word[s:e] in self.scores else self.char_ids(word[s]))
        ]


class Folder:
    """The lattice and the priority fold of many words at once, as arrays, for a task.

    Symbols are pieces; an edge is a pair of neighbouring symbols that the table
    of pairs joins to a piece. Each round takes the best edge of every word that
    has one, the leftmost of equals.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        names = list(pieces.scores)
        place = {p: i for i, p in enumerate(names)}
        order = sorted(names, key=lambda p: -pieces.scores[p][0])
        rank, last = {}, None  # equal scores share a rank
        for p in order:
            if pieces.scores[p][0] != last:
                last, n = pieces.scores[p][0], len(rank)
            rank[p] = n
        pairs = {
            (place[p[:k]] << 32 | place[p[k:]]): (rank[p], place[p])
            for p in names for k in range(1, len(p)) if p[:k] in place and p[k:] in place
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.ids = np.array([pieces.scores[p][1] for p in names], np.int64)
        self.chars = {p: i for p, i in place.items() if len(p) == 1}
        if any(c not in self.chars for p in names for c in p):
            raise ValueError("a piece has a character that is no piece")

    def fold(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all their ids)."""
        text = "".join(words)
        unknown = sorted(set(text) - self.chars.keys())
        low = -1 - np.arange(len(unknown))
        codes = {**self.chars, **dict(zip(unknown, low.tolist()))}
        sym = np.fromiter(map(codes.__getitem__, text), np.int64, len(text))
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_sym, done_word, done_at = [], [], []
        at = np.arange(len(sym))
        none = np.iinfo(np.int64).max
        while len(sym) and len(self.keys):
            key = np.where((sym[:-1] >= 0) & (sym[1:] >= 0) & (word[:-1] == word[1:]), sym[:-1] << 32 | sym[1:], -1)
            hit = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[hit] == key
            # rank first, then place: the least is the best edge, the leftmost of equals
            best = np.where(known, self.rank[hit] << 32 | np.arange(len(key)), none)
            best = np.append(best, none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(best, starts)
            going = least != none
            left = least[going] & 0xFFFFFFFF
            sym[left] = self.made[hit[left]]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            active = np.repeat(going, np.diff(np.append(starts, len(sym))))
            rest = keep & ~active
            done_sym.append(sym[rest]), done_word.append(word[rest]), done_at.append(at[rest])
            keep &= active
            sym, word, at = sym[keep], word[keep], at[keep]
        done_sym.append(sym), done_word.append(word), done_at.append(at)
        back = np.argsort(np.concatenate(done_at), kind="stable")
        sym, word = np.concatenate(done_sym)[back], np.concatenate(done_word)[back]
        n = np.ones(len(sym), np.int64)
        ids = self.ids[np.maximum(sym, 0)] if len(self.ids) else np.zeros(len(sym), np.int64)
        if unknown:  # by their bytes
            spelled = [self.pieces.char_ids(c) for c in unknown]
            n = np.where(sym < 0, np.array([len(x) for x in spelled])[np.maximum(-1 - sym, 0)], 1)
            out = np.repeat(ids, n)
            ends = np.cumsum(n)
            for i in np.flatnonzero(sym < 0).tolist():
                out[ends[i] - n[i] : ends[i]] = spelled[-1 - sym[i]]
            ids = out
        lengths = np.zeros(len(words), np.int64)
        np.add.at(lengths, word, n)
        return lengths, ids.astype("<i4")


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


def words_of(text: str) -> list[str]:
    """The words of a text, each with the ``▁`` before it."""
    if text and "  " not in text and SPACE not in text and text[-1] != " " and text[0] != " ":
        return [SPACE + w for w in text.split(" ")]
    return _WORDS((SPACE + text).replace(" ", SPACE)) if text else []


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges): edges are the pieces in the word as (s, e, score, id), s and e its first and last place + 1.

    The piece table is as large as the vocabulary and no larger, so it is broadcast.
    """
    n = F.length("word")
    spans = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda s: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - s)),
            lambda k: F.struct(s.alias("s"), (s + k).alias("e")),
        ),
    )
    cut = words.where(n > 0).select("word", F.explode(F.flatten(spans)).alias("x"))
    cut = cut.select("word", "x.s", "x.e", F.col("word").substr(F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("piece"))
    table = F.broadcast(pieces.table(words.sparkSession))
    edge = F.struct("s", "e", "score", "id")
    # a word whose characters are all outside the table keeps its row
    found = cut.join(table, "piece", "left").groupBy("word")
    return found.agg(F.collect_list(F.when(F.col("id").isNotNull(), edge)).alias("edges"))


def _priority(edges: Column) -> Column:
    """The edges that join symbols, the best first and the leftmost of equals."""
    return F.array_sort(
        F.transform(
            F.filter(edges, lambda x: x["e"] - x["s"] > 1),
            lambda x: F.struct((-x["score"]).alias("p"), x["s"].alias("s"), x["e"].alias("e")),
        )
    )


def _merge_fold(n: Column, order: Column) -> Column:
    """Boundaries left when edges, given by priority, have joined neighbours."""

    def step(marks: Column, _: Column) -> Column:
        def fits(x: Column) -> Column:
            at = F.array_position(marks, x["s"])
            return (at > 0) & (F.array_position(marks, x["e"]) == at + 2)

        first = F.slice(F.filter(order, fits), 1, 1)
        joined = F.transform(first, lambda b: F.filter(marks, lambda p: (p <= b["s"]) | (p >= b["e"])))
        return F.coalesce(F.get(joined, F.lit(0)), marks)

    # no more joins than inner boundaries; none where no edge joins
    steps = F.when(F.size(order) > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), n), step)


def _viterbi_fold(n: Column, edges: Column, floor: float) -> Column:
    """Boundaries of the best-scoring path; a character outside the table is an edge of score ``floor``."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

    def step(best: Column, e: Column) -> Column:
        ending = F.transform(
            F.filter(edges, lambda x: x["e"] == e),
            lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s")),
        )
        alone = F.struct((F.get(best, e - 1)["score"] + F.lit(floor)).alias("score"), (e - 1).alias("s"))
        known = F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1))
        return F.array_append(best, F.array_max(F.when(known, ending).otherwise(F.array_append(ending, alone))))

    best = F.aggregate(F.sequence(F.lit(1), n), start, step)

    def back(marks: Column, _: Column) -> Column:
        at = F.get(marks, F.lit(0))
        return F.when(at == 0, marks).otherwise(F.array_prepend(marks, F.get(best, at)["s"]))

    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)


def fold(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of a lattice."""
    n, own = F.length("word"), F.col("edges")
    if pieces.kind == "bpe":
        edges = edges.withColumn("order", _priority(own))
        marks = _merge_fold(n, F.col("order"))
    else:
        floor = min((s for s, _ in pieces.scores.values()), default=0.0) - UNKNOWN
        marks = _viterbi_fold(n, own, floor)
    cut = edges.withColumn("marks", marks)
    spans = F.arrays_zip(F.slice("marks", 1, F.size("marks") - 1).alias("s"), F.slice("marks", 2, F.size("marks")).alias("e"))
    byte_ids = F.array(*map(F.lit, pieces.byte_ids))

    def ids_of(x: Column) -> Column:
        found = F.filter(own, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"]))
        char = F.col("word").substr(x["s"] + 1, F.lit(1))
        raw = F.transform(
            F.sequence(F.lit(0), F.octet_length(char) - 1),
            lambda i: F.get(byte_ids, F.conv(F.hex(char).substr(2 * i + 1, F.lit(2)), 16, 10).cast("int")),
        )
        raw = F.when(F.array_contains(raw, pieces.unknown_id), F.array(F.lit(pieces.unknown_id))).otherwise(raw)
        return F.when(F.size(found) > 0, F.transform(found, lambda y: y["id"])).otherwise(raw)

    return cut.select("word", F.flatten(F.transform(spans, ids_of)).alias("ids"))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of each distinct word of ``words`` (word), dealt out by word."""
    parts = 2 * words.sparkSession.sparkContext.defaultParallelism
    return fold(lattice(words.select("word").repartition(parts, "word").distinct(), pieces), pieces)


def frequent_words(docs: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` of the commonest words that occur more than once and are at most LONGEST characters long.

    Counts are put into steps of a sixteenth of an octave, and the highest steps
    that hold no more than ``limit`` words are taken; no task gathers them.
    """
    # runs of spaces make other words; those are left to the tasks
    parts = F.split(F.col("text"), " ", -1)
    counts = cut(
        docs.where("text <> ''")
        .select(F.explode(parts).alias("word"))
        .where(F.length("word") < LONGEST)
        .groupBy("word")
        .agg(F.floor(F.log2(F.count("*")) * 16).cast("int").alias("step"))
        .where("step > 0")
    )
    # a row for each step, a thousand at most
    sizes = {r["step"]: r["count"] for r in counts.groupBy("step").count().collect()}
    least, held = 1 << 30, 0
    for step in sorted(sizes, reverse=True):
        held += sizes[step]
        if held > limit:
            break
        least = step
    return counts.where(F.col("step") >= least).select(F.concat(F.lit(SPACE), "word").alias("word"))


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts with about CHUNK characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i == len(texts) - 1:
            yield first, i + 1 - first
            first, size = i + 1, 0


def _chunk(texts: list[str | None], known: dict[str, bytes], pieces: Pieces, folder: Folder | None) -> pa.ListArray:
    """Each text's ids; the chunk's distinct words are looked up or folded once."""
    lists = [words_of(t or "") for t in texts]
    coded = pa.array([w for words in lists for w in words], pa.string()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = [known.get(w) for w in names]
    rare = [i for i, r in enumerate(raw) if r is None]
    lengths = np.array([0 if r is None else len(r) // 4 for r in raw], np.int64)
    if folder is not None:
        own, ids = folder.fold([names[i] for i in rare])
    else:
        found = [np.array(pieces.ids(names[i]), "<i4") for i in rare]
        own, ids = np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, "<i4"), *found])
    # known words first, then the rare, then back into the order of the dictionary
    common = np.frombuffer(b"".join(r for r in raw if r is not None), "<i4")
    place = np.empty(len(names), np.int64)
    is_rare = np.zeros(len(names), bool)
    is_rare[rare] = True
    place[~is_rare], place[is_rare] = np.arange(len(names) - len(rare)), np.arange(len(names) - len(rare), len(names))
    sizes = np.concatenate((lengths[~is_rare], own))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    table = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate((common, ids)).astype(np.int32)))
    at = place[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
    stream = table.take(pa.array(at)).flatten()
    ends = np.concatenate(([0], np.cumsum(sizes[at])))
    stops = ends[np.cumsum([0, *map(len, lists)])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), stream)


def _encoded(docs: DataFrame, pieces: Pieces, frequent: int, finish: Callable, schema: str) -> DataFrame:
    """``finish(doc_ids, ids)`` of every chunk of ``docs``, in the worker that encodes it."""
    common = encode_words(frequent_words(docs, frequent), pieces).toPandas()
    known = {w: np.asarray(i, "<i4").tobytes() for w, i in zip(common["word"], common["ids"])}
    shared = docs.sparkSession.sparkContext.broadcast((known, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = shared.value
        folder = Folder(pieces) if pieces.kind == "bpe" else None
        for batch in batches:
            for at, n in _parts(batch.column(1).to_pylist()):
                part = batch.slice(at, n)
                yield finish(part.column(0), _chunk(part.column(1).to_pylist(), known, pieces, folder))
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with less

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, pieces: Pieces | None = None, frequent: int = 1 << 17) -> DataFrame:
    """(doc_id, ids) of every row."""

    def finish(doc_ids: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, ids], ["doc_id", "ids"])

    return _encoded(docs, pieces or Pieces.load(), frequent, finish, "doc_id long, ids array<int>")


def _bytes_by_id(pieces: Pieces) -> dict[int, bytes]:
    out = {i: p.replace(SPACE, " ").encode() for p, (_, i) in pieces.scores.items()}
    out.update({i: bytes([b]) for b, i in enumerate(pieces.byte_ids) if i != pieces.unknown_id})
    return out


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); ids outside the table add nothing."""
    table = _bytes_by_id(pieces or Pieces.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                raw = b"".join([table.get(i, b"") for i in ids.values.to_pylist()] if ids.is_valid else [])
                texts.append(raw.decode("utf-8", "replace").removeprefix(" "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, pieces: Pieces | None = None, frequent: int = 1 << 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256."""
    pieces = pieces or Pieces.load()
    table = _bytes_by_id(pieces)

    def finish(doc_ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        n, crc, sha = [], [], []
        for ids in lists:
            own = ids.values.to_numpy().astype("<u4")
            raw = b"".join(map(table.__getitem__, own.tolist()))
            text = raw.decode("utf-8", "replace").removeprefix(" ")
            n.append(len(own))
            crc.append(zlib.crc32(own.tobytes()))
            sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        columns = [doc_ids, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string"
    return _encoded(docs, pieces, frequent, finish, schema)
