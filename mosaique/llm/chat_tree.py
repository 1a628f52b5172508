"""Chat formatting as a prefix tree.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Roles and texts are
escaped so that no control string can come from them: ``\\`` becomes ``\\\\``,
``<|`` becomes ``<\\|`` and, in roles, a line feed becomes ``\\n``; that is undone
exactly. Conversations that begin with the same turns share the nodes of those
turns. Each node's text is encoded once, by a lossless byte-level BPE.

Conversations (equal ones once) are sorted by the path of their nodes' hashes;
in that order each adds the nodes that its predecessor lacks, which is the tree
depth-first. The sort deals paths out by ranges, so a first turn that a third of
all conversations share spans many tasks; what a task's first path shares with
the path before it is not emitted again. A node's row has its place in the
stream, its position ids (which go on from its parent's) and the stream
intervals of its ancestors, neighbouring ones as one, all that its tokens may
attend to besides themselves; a conversation that nothing branches off has one
interval at each of its turns. Reading a conversation back takes the nodes from
its last one up and nothing else, once for all equal conversations; what a
conversation with a large share of all copies holds is dealt out by conv_id too.

Turns are ordered by turn, then role and text; repeated rows are turns of their
own. Null roles and texts are empty; a null turn comes first; rows with a null
conv_id are one conversation. A conversation is formatted by one task. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaique.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>\n"
#: Bytes of a node's hash, which covers all turns up to it.
HASH = 16
#: A leaf with over one conversation in HOT is dealt out in SPLIT parts.
HOT, SPLIT = 1024, 64


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    # no control string holds a backslash, so what follows one is literal
    parts = text.split("\\\\")
    return "\\".join(p.replace("<\\|", "<|") for p in parts)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    parts = role.split("\\\\")
    return "\\".join(p.replace("\\n", "\n").replace("<\\|", "<|") for p in parts)


def turn_text(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}"


def read_turn(written: str) -> tuple[str, str]:
    """(role, text) of one written turn."""
    role, text = written[len(START) : -len(END)].split("\n", 1)
    return unescape_role(role), unescape(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    return tok


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for turns in pdf["turns"]:
            path, h = [], b""
            written = [turn_text(t["role"], t["text"]) for t in turns]
            for w in written:
                h = hashlib.blake2b(h + w.encode("utf-8", "surrogatepass"), digest_size=HASH).digest()
                path.append(h)
            rows.append((b"".join(path), written))
        yield pd.DataFrame(rows, columns=["path", "written"]).assign(conv_id=pdf["conv_id"])


def _split(path: bytes) -> list[bytes]:
    return [path[i : i + HASH] for i in range(0, len(path), HASH)]


def _shared(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _encoded(tokenizer_path: str):
    """Per sorted partition: each path with the tokens of the turns that the path before it in the partition lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, part, before, row = _tokenizer(tokenizer_path), TaskContext.get().partitionId(), [], 0
        for pdf in batches:
            out = []
            for raw, written in zip(pdf["path"], pdf["written"]):
                path = _split(raw)
                at = _shared(path, before)
                new = tok.encode_batch_fast([str(w) for w in written[at:]], add_special_tokens=False)
                out.append((part, row, raw, at, [e.ids for e in new]))
                before, row = path, row + 1
            yield pd.DataFrame(out, columns=["part", "row", "path", "at", "ids"])

    return run


def _partition_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each partition: its first and last path, and the tokens of the nodes on them, and of all its nodes."""
    found: dict[int, dict] = {}
    for pdf in batches:
        for part, raw, at, ids in zip(pdf["part"], pdf["path"], pdf["at"], pdf["ids"]):
            sizes = [len(x) for x in ids]
            x = found.setdefault(part, {"first": raw, "first_sizes": sizes, "stack": [], "total": 0})
            stack = x["stack"][:at]
            for n in sizes:
                stack.append((x["total"], n))
                x["total"] += n
            x["stack"], x["last"] = stack, raw
    yield pd.DataFrame(
        [
            (p, x["first"], x["first_sizes"], x["last"], [s for s, _ in x["stack"]], [n for _, n in x["stack"]], x["total"])
            for p, x in found.items()
        ],
        columns=["part", "first", "first_sizes", "last", "starts", "sizes", "total"],
    )


def _begins(ends: list) -> dict[int, tuple[int, int, list[tuple[int, int]]]]:
    """Of each partition: where its tokens begin, turns of its first path emitted before, and the intervals of these."""
    base, stack, last, out = 0, [], [], {}
    for e in sorted(ends, key=lambda x: x["part"]):
        again = _shared(_split(bytes(e["first"])), last)
        held = stack[:again]
        out[e["part"]] = base, again, held
        gone = sum(e["first_sizes"][:again])
        own = list(zip(e["starts"], e["sizes"]))
        last = _split(bytes(e["last"]))
        # the partition's own places count what is not emitted again
        n_held = _shared(last, _split(bytes(e["first"])))
        stack = [held[i] if i < min(again, n_held) else (base + s - gone, n) for i, (s, n) in enumerate(own)]
        base += e["total"] - gone
    return out


NODES = (
    "kind int, start long, length long, tokens array<int>, position long, "
    "ancestors array<struct<start: long, length: long>>, starts array<long>, leaf binary"
)


def intervals(stack: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) of the nodes of a path, neighbouring ones as one."""
    out: list[tuple[int, int]] = []
    for start, n in stack:
        if out and sum(out[-1]) == start:
            out[-1] = out[-1][0], out[-1][1] + n
        else:
            out.append((start, n))
    return out


def _structs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "length": n} for s, n in spans]


class _Emitter:
    """Walks a partition's paths in order. Rows of kind 0 are nodes; those of kind 1 have a path's leaf, intervals and nodes."""

    def __init__(self, begin):
        self.place, self.again, self.held = begin
        self.stack: list[tuple[int, int]] | None = None

    def rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw, at, ids in zip(pdf["path"], pdf["at"], pdf["ids"]):
            ids = list(ids)
            if self.stack is None:
                self.stack, ids = list(self.held), ids[self.again :]
            else:
                self.stack = self.stack[:at]
            up, position = intervals(self.stack), sum(n for _, n in self.stack)
            for tokens in ids:
                out.append((0, self.place, len(tokens), tokens, position, _structs(up), None, None))
                self.stack.append((self.place, len(tokens)))
                up = intervals([*up, self.stack[-1]])
                self.place += len(tokens)
                position += len(tokens)
            out.append((1, None, None, None, None, _structs(up), [s for s, _ in self.stack], raw[-HASH:]))
        columns = ["kind", "start", "length", "tokens", "position", "ancestors", "starts", "leaf"]
        pdf = pd.DataFrame(out, columns=columns)
        return pdf.astype({c: "Int64" for c in ("start", "length", "position")})


def _by_part(begins: dict[int, tuple[int, int, list[tuple[int, int]]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, held = None, None
        for pdf in batches:
            for part, own in pdf.groupby("part", sort=False):
                if part != held:
                    held, work = part, _Emitter(begins[part])
                yield work.rows(own)

    return run


def tree(turns: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations) of ``turns`` (conv_id, turn, role, text).

    nodes: start, length, tokens, position (of the first token; the others
    follow), ancestors (intervals of the stream). conversations: conv_id, leaf,
    intervals (all that they hold of the stream) and starts of their nodes in order.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    paths = cut(
        told.select(F.col("conv_id").cast("string"), "turns")
        .mapInPandas(_paths, "path binary, written array<string>, conv_id string")
        .withColumn("conv_id", F.col("conv_id").cast("long"))
    )
    distinct = paths.groupBy("path").agg(F.first("written").alias("written"))
    schema = "part int, row long, path binary, at int, ids array<array<int>>"
    own = cut(
        distinct.repartitionByRange("path")
        .sortWithinPartitions("path")
        .mapInPandas(_encoded(tokenizer_path or default_path()), schema)
    )
    # the files of a partition may be read in pieces, so its rows are brought together again
    dealt = own.repartition("part").sortWithinPartitions("part", "row")
    # a row for each partition of the sort
    ends = dealt.mapInPandas(
        _partition_ends,
        "part int, first binary, first_sizes array<long>, last binary, starts array<long>, sizes array<long>, total long",
    ).collect()
    rows = cut(dealt.mapInPandas(_by_part(_begins(ends)), NODES))
    nodes = rows.where("kind = 0").select("start", "length", "tokens", "position", "ancestors")
    leaves = rows.where("kind = 1").select("leaf", F.col("ancestors").alias("intervals"), "starts")
    leaf = F.expr(f"substring(path, -{HASH}, {HASH})")
    return nodes, _with_leaf(paths.select("conv_id", leaf.alias("leaf")), leaves)


def _with_leaf(named: DataFrame, leaves: DataFrame) -> DataFrame:
    """``named`` (conv_id, leaf) joined to one row per leaf; leaves with over one in HOT of all conversations are dealt out."""
    n = named.count()
    # HOT rows of a hash at most, by that definition
    held = named.groupBy("leaf").agg(F.count("*").alias("k")).where(F.col("k") * HOT > max(n, HOT * SPLIT)).select("leaf").collect()
    if not held:
        return named.join(leaves, "leaf")
    is_hot = F.col("leaf").isin([bytes(r["leaf"]) for r in held])
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(is_hot, F.pmod(F.xxhash64("conv_id"), F.lit(SPLIT))).otherwise(F.lit(0)).cast("int")
    dealt = leaves.withColumn("salt", F.explode(salts))
    return named.withColumn("salt", salt).join(dealt, ["leaf", "salt"]).drop("salt")


def read_leaves(nodes: DataFrame, conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(leaf, turns): each distinct conversation's written turns, decoded from its nodes."""
    path = tokenizer_path or default_path()

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for pdf in batches:
            lists = [[int(i) for i in t] for t in pdf["tokens"]]
            yield pd.DataFrame({"start": pdf["start"], "written": tok.decode_batch(lists, skip_special_tokens=False)})

    texts = nodes.select("start", "tokens").mapInPandas(decoded, "start long, written string")
    # equal conversations are read back once
    leaves = conversations.groupBy("leaf").agg(F.first("starts").alias("starts"))
    steps = leaves.select("leaf", F.posexplode("starts").alias("place", "start"))
    return (
        steps.join(texts, "start")
        .groupBy("leaf")
        .agg(F.array_sort(F.collect_list(F.struct("place", "written"))).alias("turns"))
        .select("leaf", F.col("turns.written").alias("turns"))
    )


def read_back(nodes: DataFrame, conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(conv_id, turns): each conversation's written turns."""
    whole = read_leaves(nodes, conversations, tokenizer_path)
    return _with_leaf(conversations.select("conv_id", "leaf"), whole).select("conv_id", "turns")


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for turns in pdf["turns"]:
            read = [read_turn(w) for w in turns]
            all_of_it = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in read).encode("utf-8", "surrogatepass"))
            loss = "".join(t for r, t in read if r == "assistant")
            out.append(
                (
                    len(read),
                    all_of_it.hexdigest(),
                    len(loss),
                    hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(),
                    sum(map(len, turns)),
                )
            )
        columns = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pd.DataFrame(out, columns=columns).assign(leaf=pdf["leaf"])


def digest(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per conversation, read back from the tree; the loss mask covers what assistants say."""
    nodes, conversations = tree(turns, tokenizer_path)
    columns = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = read_leaves(nodes, conversations, tokenizer_path).mapInPandas(_digested, f"{columns}, leaf binary")
    return _with_leaf(conversations.select("conv_id", "leaf"), read).drop("leaf")
