"""Order-preserving packing of documents into training sequences.

Within a task the documents' tokens, each document closed by ``end_id``, form
one stream in stored order. Windows of at most ``size`` tokens cut it. A cut
costs nothing at a document's end, ``at_sentence`` where a sentence ends inside
a document and ``inside`` elsewhere (tried every ``STRIDE`` tokens of long
sentences); a window costs its padding to ``size`` (that a power of two is not
padded is left out: half windows would save little padding and make more
sequences). With
cost(i) for the best way to end a window at cut i, cost(j) = penalty(j) + size -
pos(j) + min(cost(i) + pos(i)) over the cuts i within ``size`` before j, a
sliding minimum that a monotone queue gives in constant time a cut. Of equally
good windows the shortest is taken. The stream is solved in stretches of ``STRETCH``
windows; the last ``OVERLAP`` of each are left to the next one.

Rows: null and empty texts are a document of the one token ``end_id``. Repeated
and null doc_ids keep their rows. Documents of any length are cut as often as
needed. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mosaique.llm.word_bpe import shared

STRIDE, STRETCH, OVERLAP = 32, 128, 8

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def best_cuts(pos: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indexes into ``pos`` (rising, from 0, in steps of ``size`` at most) of the cheapest cuts from the first to the last."""
    p, pen = pos.tolist(), penalty.tolist()
    cost, back = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])  # cuts with rising cost + position
    value = [0.0] * len(p)
    value[0] = p[0]
    for j in range(1, len(p)):
        while p[j] - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = pen[j] + size - p[j] + value[i]
        v = value[j] = cost[j] + p[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts = [len(p) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(
    ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, at_sentence: float, inside: float, size: int = 4096
) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, 0 and its end among them, and what a cut there costs."""
    n, stride = len(ids), max(1, min(STRIDE, size // 2))
    soft, hard, doc = (np.zeros(n + 1, bool) for _ in range(3))
    soft[1:] = ends[ids]
    doc[doc_ends] = True
    doc[[0, n]] = True
    marks = np.flatnonzero(soft | doc)
    for i in np.flatnonzero(np.diff(marks) > min(2 * stride, size)).tolist():
        hard[marks[i] + stride : marks[i + 1] : stride] = True
    pos = np.flatnonzero(soft | doc | hard)
    penalty = np.where(doc[pos], 0.0, np.where(soft[pos], at_sentence, inside))
    return pos, penalty


class Packer:
    """Takes documents in order and gives the pieces of the windows that are settled."""

    def __init__(self, ends: np.ndarray, size: int, at_sentence: float, inside: float, first_sequence: int):
        self.ends, self.size, self.at, self.inside = ends, size, at_sentence, inside
        self.sequence = first_sequence
        self.docs: deque[tuple[int | None, int, np.ndarray]] = deque()  # id, tokens already packed, ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, 0, ids))
        self.held += len(ids)
        return self.pack(False) if self.held >= self.size * STRETCH else []

    def pack(self, all_of_it: bool) -> list[tuple]:
        if not self.held:
            return []
        stream = np.concatenate([ids[at:] for _, at, ids in self.docs])
        doc_ends = np.cumsum([len(ids) - at for _, at, ids in self.docs])
        pos, penalty = candidates(stream, doc_ends, self.ends, self.at, self.inside, self.size)
        cuts = pos[best_cuts(pos, penalty, self.size)].tolist()
        if not all_of_it:
            cuts = cuts[: max(2, len(cuts) - OVERLAP)]
        return [row for a, b in zip(cuts, cuts[1:]) for row in self._window(b - a)]

    def _window(self, left: int) -> list[tuple]:
        rows, offset = [], 0
        while left:
            doc_id, at, ids = self.docs[0]
            n = min(left, len(ids) - at)
            rows.append((doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), self.sequence, offset))
            if at + n == len(ids):
                self.docs.popleft()
            else:
                self.docs[0] = (doc_id, at + n, ids)
            left, offset, self.held = left - n, offset + n, self.held - n
        self.sequence += 1
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(
    docs: DataFrame,
    size: int = 4096,
    end_id: int = 2,
    at_sentence: float = 8.0,
    inside: float = 16.0,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        packer = Packer(bpe.sentence_ends(), size, at_sentence, inside, first)
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.chunks(texts)):
                rows += packer.add(doc_id, np.append(ids, end))
            if rows:
                yield _batch(rows)
                rows = []
        if rows := packer.pack(True):
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
