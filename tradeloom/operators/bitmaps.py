"""Sets of small whole numbers as a few integer columns, merged by `bit_or` on the map side.

Number p is bit p % WORD of word p DIV WORD. Words hold 60 bits, so that they stay positive.
Numbers are given as SQL text, so that an expression of any size is built by one call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.scratch import written

WORD = 60

# A filter has a bit for each of so many slots per hash, and 2 ** 28 slots (32 MB) at most.
_SLOTS_PER_HASH, _MOST_SLOT_BITS = 16, 28
_WORD_BITS, _CHUNK_BITS = 6, 9  # 64 slots are a word, 512 words a row


def names(words: int) -> list[str]:
    return [f"_bits{i}" for i in range(words)]


def collected(number: str, words: int) -> list[Column]:
    """One aggregate per word: the set of the numbers of a group."""
    bit = f"shiftleft(1L, CAST(({number}) % {WORD} AS INT))"
    return [F.expr(f"bit_or(IF(({number}) DIV {WORD} = {i}, {bit}, 0L))").alias(n) for i, n in enumerate(names(words))]


def merged(words: int) -> list[Column]:
    return [F.bit_or(n).alias(n) for n in names(words)]


def lowest(words: int) -> Column:
    """The smallest number of a set; NULL for an empty one."""
    cases = (f"WHEN {n} != 0 THEN bit_count(({n} & -{n}) - 1) + {i * WORD}" for i, n in enumerate(names(words)))
    return F.expr(f"CASE {' '.join(cases)} END")


def following(number: str, words: int, many: int) -> Column:
    """Bit i tells whether the set holds number + i, for the `many` numbers from `number` on."""
    own = [*names(words), "0L"]
    this = " ".join(f"WHEN {i} THEN {own[i]}" for i in range(words))
    after = " ".join(f"WHEN {i} THEN {own[i + 1]}" for i in range(words))
    at, word = f"CAST(({number}) % {WORD} AS INT)", f"({number}) DIV {WORD}"
    low = f"shiftright(CASE {word} {this} ELSE 0L END, {at})"
    high = f"shiftleft(CASE {word} {after} ELSE 0L END, {WORD} - {at})"
    return F.expr(f"({low} | {high}) & {(1 << many) - 1}L")


def members(words: int) -> Column:
    """The numbers of a set, ascending."""
    word = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(names(words)))
    held = f"(shiftright(CASE p DIV {WORD} {word} END, CAST(p % {WORD} AS INT)) & 1L) = 1L"
    return F.expr(f"filter(sequence(0, {words * WORD - 1}), p -> {held})")


def may_be_among(rows: DataFrame, hashes: DataFrame, column: str, count: int, name: str) -> DataFrame:
    """`rows` with a flag that is false only if the hash in `column` is not one of the `count` hashes.

    The hashes become a bitmap of bounded size that each task has at hand, so `rows` are not moved.
    With very many hashes more flags are true for nothing.
    """
    slot_bits = min((_SLOTS_PER_HASH * count).bit_length(), _MOST_SLOT_BITS)
    slot_bits = max(slot_bits, _WORD_BITS + _CHUNK_BITS)
    slot = f"({column} & {(1 << slot_bits) - 1}L)"
    bit = F.expr(f"shiftleft(1L, CAST({slot} & {(1 << _WORD_BITS) - 1}L AS INT))")
    empty = hashes.sparkSession.range(1 << (slot_bits - _WORD_BITS)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    held = hashes.select(F.expr(f"shiftright({slot}, {_WORD_BITS})").alias("word"), bit.alias("bits"))
    words = empty.unionByName(held).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    chunks = words.groupBy(F.shiftright("word", _CHUNK_BITS).alias("_chunk")).agg(F.transform(in_order, lambda w: w["bits"]).alias("_words"))
    word = F.expr(f"get(_words, CAST(shiftright({slot}, {_WORD_BITS}) & {(1 << _CHUNK_BITS) - 1}L AS INT))")
    flag = F.getbit(word, F.expr(f"CAST({slot} & {(1 << _WORD_BITS) - 1}L AS INT)")) == 1
    at = rows.withColumn("_chunk", F.expr(f"shiftright({slot}, {_WORD_BITS + _CHUNK_BITS})"))
    return at.join(F.broadcast(written(chunks, "bitmap")), "_chunk").select(*rows.columns, flag.alias(name))
