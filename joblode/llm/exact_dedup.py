"""Exact duplicates of texts through a two-pass Bloom filter, with DataFrame operations only.

Pass one counts how many rows set each slot of a Bloom filter; the bits hit at least twice make the filter of
possibly repeated hashes. Pass two tests each row against that filter. A row with a slot of its own cannot be
repeated and passes straight through; only the others shuffle. The filter has `filter_bits` bits (by default 16
for each row, 2**27 at most, a broadcast of at most 2**21 words); beyond that it lets more rows through to the
exact step, which stays whole.

Null text counts as empty. Rows that repeat a text and an id are one document: they carry the same flag, and
drop_copies() keeps one of them. A null id is the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm.common import attach, fresh, quoted, staged, with_columns_of

MAX_FILTER_BITS = 1 << 27
WORD = 6


def text_key(text: str) -> Column:
    """SHA-256 of the text in UTF-8, as bytes."""
    return F.unhex(F.sha2(F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary"), 256))


def filter_bits(rows: int) -> int:
    bits = 1 << 16
    while bits < 16 * rows and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def _slots(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in (1, 2)]


def repeated_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Pass one: the words (64 bits each) of the filter of slots that at least two rows set."""
    slots = keys.select(F.explode(F.array(*_slots(key, bits))).alias("slot")).groupBy("slot").count().where("count > 1")
    word, bit = F.shiftright("slot", WORD), F.col("slot").bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")
    return slots.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))


def flagged(rows: DataFrame, key: str, words: DataFrame, bits: int, flag: str) -> DataFrame:
    """Pass two: whether all slots of a row are set in the filter, in column `flag`; no shuffle."""
    out, tests = rows, []
    for i, slot in enumerate(_slots(key, bits)):
        word, mask = fresh(rows, f"word{i}", f"mask{i}")
        look = words.select(F.col("word").alias(word), F.col("bits").alias(mask))
        out = out.join(F.broadcast(look), F.shiftright(slot, WORD) == F.col(word), "left")
        bit = F.call_function("shiftrightunsigned", F.col(mask), slot.bitwiseAND(F.lit((1 << WORD) - 1)).cast("int"))
        tests.append(F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    return out.select(*(quoted(c) for c in rows.columns), (tests[0] & tests[1]).alias(flag))


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays."""
    keys = staged(docs.select(quoted(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key")), "copy-keys")
    total = keys.count()
    bits = filter_bits(total)
    tested = flagged(keys, "key", repeated_words(keys, "key", bits), bits, "maybe")
    maybe = tested.where("maybe").drop("maybe")
    groups = maybe.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    alone = tested.where("not maybe").select("doc_id", "key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    every = alone.unionByName(attach(maybe, groups, "key", "group_size", total))
    return every.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that cannot be repeated do not shuffle."""
    key, maybe, keep = fresh(docs, "copy_key", "maybe_copy", "keep_id")
    keyed = docs.withColumn(key, text_key(text))
    keys = staged(keyed.select(quoted(doc_id).cast("long").alias("doc_id"), F.col(key).alias("key")), "copy-keys")
    bits = filter_bits(keys.count())
    words = staged(repeated_words(keys, "key", bits), "copy-filter")
    keepers = (
        flagged(keys, "key", words, bits, "maybe").where("maybe")
        .groupBy(F.col("key").alias(key)).agg(F.max("doc_id").alias(keep))
    )
    tested = flagged(keyed, key, words, bits, maybe)
    rows = tested.where(F.col(maybe)).alias("r")
    kept = rows.join(
        keepers.alias("k"),
        quoted(doc_id).cast("long").eqNullSafe(F.col(f"k.{keep}")) & (F.col(f"r.{key}") == F.col(f"k.{key}")), "left_semi",
    ).dropDuplicates([doc_id, key])
    return with_columns_of(tested.where(~F.col(maybe)), docs.columns).unionByName(with_columns_of(kept, docs.columns))
