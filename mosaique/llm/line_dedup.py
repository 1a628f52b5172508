"""Line dedup with DataFrame functions only.

A text is cut at ``\\n``; a line's key is the line stripped of ASCII white space
at both ends with A-Z lower-cased. Keys of at least ``min_chars`` code points
that ``min_docs`` documents hold lose all their lines except in the largest
doc_id that holds them.

Keys are taken once and written as 128-bit hashes. Lines are dealt out by ranges
of the hash and sorted by hash, document (largest first) and position; the first
document of each run of equal hashes keeps its lines and, in one pass over the
run, the others lose theirs. What comes back per document is a bitmap of the
lines it keeps, 64 to a word, compressed by leaving out words that keep all: no
text moves with the lines. Hashes that may hold over one line in ``HOT`` are
also dealt by document, and their totals are broadcast; by that definition there
are at most ``HOT`` of them, which a frequent-items sketch of more rows names.

Rows: a null or empty text is one empty line. A repeated doc_id counts as one
document, and each of its rows is judged by itself. A null doc_id counts as one
document that is never the largest unless it is the only one. An empty table
gives an empty result. Other columns pass
:func:`drop_lines` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaique.operators.graph import cut

#: A hash with over one line in so many is dealt by document too; rows that the sketch keeps.
HOT, SKETCH_ROWS = 1024, 16384

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that lower() changes though A-Z lower-casing must not.
_OTHER_UPPER = r"[\p{IsUppercase}\p{IsTitlecase}&&[^A-Z]]"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased; lower() where that is the same, for it is far quicker."""
    stripped = F.btrim(line, F.lit(_SPACE))
    return F.when(
        stripped.rlike(_OTHER_UPPER), F.translate(stripped, _UPPER, _LOWER)
    ).otherwise(F.lower(stripped))


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key is long enough; ``row`` tells rows of a doc_id apart."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where(F.length(F.btrim("line", F.lit(_SPACE))) >= min_chars)  # lower-casing A-Z keeps the length
        .select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def _hot_keys(lines: DataFrame) -> list[int]:
    """The values of h1 that may hold over one line in HOT, so HOT at most."""
    top = lines.agg(F.expr(f"approx_top_k(h1, {HOT}, {SKETCH_ROWS})").alias("top"), F.count("*").alias("n")).first()
    return [x["item"] for x in top["top"] or [] if x["count"] > 1 and x["count"] * HOT >= top["n"]]


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, row, words): for rows that lose lines, the compressed bitmap of the lines they keep.

    ``words`` maps position div 64 to the long whose bit position mod 64 is set where the line stays;
    words of which all lines stay are not in it.
    """
    lines = cut(_long_lines(docs, min_chars))
    hot = _hot_keys(lines)
    is_hot = F.col("h1").isin(hot)
    key = ["h1", "h2"]
    dealt = lines
    if hot:
        dealt = lines.withColumn("salt", F.when(is_hot, F.xxhash64("doc_id")).otherwise(F.lit(0)))
        key = [*key, "salt"]
    # ranges of the hash are clustered by it, so the windows need no other exchange
    run = Window.partitionBy(*key)
    largest_first = F.col("doc_id").desc_nulls_last()
    judged = (
        dealt.repartitionByRange(*key)
        .withColumn("place", F.dense_rank().over(run.orderBy(largest_first)))
        .withColumn("largest", F.first("doc_id").over(run.orderBy(largest_first, "row", "pos")))
        .withColumn("docs", F.max("place").over(run))
    )
    if hot:
        totals = (
            lines.where(is_hot)
            .select("h1", "h2", "doc_id")
            .distinct()
            .groupBy("h1", "h2")
            .agg(F.count("*").alias("all_docs"), F.max("doc_id").alias("all_largest"))
        )
        # a row for each hot hash, at most HOT but for chance collisions of its first half
        judged = judged.join(F.broadcast(totals), ["h1", "h2"], "left").select(
            "doc_id",
            "row",
            "pos",
            F.coalesce("all_docs", "docs").alias("docs"),
            F.coalesce("all_largest", "largest").alias("largest"),
        )
    gone = judged.where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("largest")))
    words = gone.groupBy("doc_id", "row", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits")
    )
    return words.groupBy("doc_id", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def _judged(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, Column, Column]:
    """(rows as a struct ``d`` with ``words``, the kept text, the number of dropped lines)."""
    text = F.col("d.text")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    found = dropped_lines(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "words"
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_row"))
    joined = own.join(found, same, "left")

    def keep(_line: Column, pos: Column) -> Column:
        bits = F.try_element_at(F.col("words"), F.shiftright(pos, 6))
        return F.coalesce(F.getbit(bits, F.pmod(pos, F.lit(64))) == 1, F.lit(True))

    kept = F.when(F.col("words").isNull(), text).otherwise(F.array_join(F.filter(lines_of(text), keep), "\n"))
    n_dropped = F.when(F.col("words").isNull(), F.lit(0).cast("long")).otherwise(
        F.aggregate(F.map_values("words"), F.lit(0).cast("long"), lambda n, w: n + 64 - F.bit_count(w))
    )
    return joined, kept, n_dropped


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines; ``n_chars``, where there is one, follows a text that changed."""
    joined, kept, _ = _judged(docs, min_chars, min_docs)
    columns = []
    for c in docs.columns:
        old = F.col("d").getField(c)
        if c == "text":
            new = kept
        elif c == "n_chars":
            new = F.when(F.col("words").isNull(), old).otherwise(F.length(kept)).cast(docs.schema[c].dataType)
        else:
            new = old
        columns.append(new.alias(c))
    return joined.select(*columns)


def digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256."""
    joined, kept, n_dropped = _judged(docs.select("doc_id", "text"), min_chars, min_docs)
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.size(lines_of(F.col("d.text"))).cast("long").alias("n_lines"),
        n_dropped.alias("n_dropped"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"),
    )
