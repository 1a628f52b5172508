"""Token ids of the lower-casing word BPE, by encoding each distinct piece of a chunk once.

The tokenizer drops white space and cuts the rest into pieces (letter runs,
single digits, other runs, English clitics) that are encoded independently. So a
chunk's words, and then their pieces, are dictionary-encoded by Arrow; the
tokenizer sees each distinct piece once and the ids are gathered back. Texts
that hold anything but Latin letters of U+017F or below and plain white space,
or one of the special tokens, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a chunk, which bounds what a task holds besides its longest text.
CHUNK = 8_000_000
#: Pieces that the tokenizer gets at once; what it returns for each is large.
BLOCK = 8192
#: Stands between words that are encoded together; no text that holds it gets there.
MARK = "\x01"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


def _gather(lengths: np.ndarray, values: np.ndarray, at: pa.Array) -> np.ndarray:
    """The lists of the given lengths in ``values``, taken in the order of ``at`` and strung together."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return lists.take(at).flatten().to_numpy()


class WordBpe:
    """``many(texts)`` gives each text's ids as tokenizers would, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # for pieces of lower-case words that are cut apart already
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        letters, digits = _class("L"), _class("N")
        space = r"\x09-\x0D\x20\xA0"
        self.split = re.compile(
            rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{space}{letters}{digits}]+"
        ).findall
        # what lower(), splitting and the pattern above may not treat as the tokenizer does
        self.odd = re.compile(r"[^\x09-\x0D\x20-\x7E\xA0-ſ]|İ|<\|(?:start|end)oftext\|>").search
        self.last = self._table("</w>")

    def _table(self, *endings: str) -> np.ndarray:
        table = np.zeros(self.tok.get_vocab_size(with_added_tokens=True) + 1, bool)
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            table[i] = piece.endswith(endings)
        return table

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all their ids)."""
        coded = pa.array(self.split(f" {MARK} ".join([*words, ""])), pa.string()).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        real = np.array([p != MARK for p in pieces], bool)
        lengths, ids = np.zeros(len(pieces), np.int64), np.zeros(0, "<u4")
        if real.any():
            known = [p for p in pieces if p != MARK]
            parts = [
                self.plain.encode_batch_fast([" ".join(known[i : i + BLOCK])], add_special_tokens=False)[0].ids
                for i in range(0, len(known), BLOCK)
            ]
            ids = np.concatenate([np.array(x, "<u4") for x in parts])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != real.sum():
                raise ValueError("a piece's ids do not end with the end of a word")
            lengths[real] = np.diff(ends, prepend=0)
        at = coded.indices.to_numpy()
        stops = np.cumsum(lengths[at])[~real[at]]
        return np.diff(stops, prepend=0), _gather(lengths, ids, coded.indices)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids; meant for a chunk of texts at a time."""
        plain = [not self.odd(t) for t in texts]
        lists = pc.utf8_split_whitespace(pa.array([t.lower() for t, p in zip(texts, plain) if p], pa.string()))
        coded = lists.flatten().dictionary_encode()
        lengths, ids = self.words(coded.dictionary.to_pylist())
        stream = _gather(lengths, ids, coded.indices)
        places = np.concatenate(([0], np.cumsum(lengths[coded.indices.to_numpy()])))
        stops = places[np.cumsum(lists.value_lengths().to_numpy())].tolist()
        own = iter([stream[a:b] for a, b in zip([0, *stops], stops)])
        return [next(own) if p else self.whole(t) for t, p in zip(texts, plain)]

    def chunks(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids, in order, a chunk of CHUNK characters at a time."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                yield from self.many(texts[first : i + 1])
                first, size = i + 1, 0

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether a sentence may end with it: . ! ? or runs that end so."""
        return self._table(".</w>", "!</w>", "?</w>")


@lru_cache(maxsize=2)
def shared(path: str | None = None) -> WordBpe:
    """One encoder per worker process and path; it remembers no words."""
    return WordBpe(path or default_path())
