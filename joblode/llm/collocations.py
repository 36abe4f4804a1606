"""Phrases whose words occur together far more often than apart, mined with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at PIECE_ENDS and those into words at blanks. Words get 64-bit hashes; prefix
polynomials over a part of texts give the fingerprint of every run of words in a piece by one subtraction and one
product. Three passes over the texts, none of which keeps a text:

1. fingerprints of words and pairs, summed by part, task and shuffle, each with a pointer (the smallest id of a document
   that holds it); what reaches `least` occurrences stays;
2. the same for runs of three and more words all of whose pairs may be frequent;
3. collisions are verified against the texts: every run whose fingerprint stayed is counted once more by its words,
   and only those phrases become strings.

A fingerprint counts at least what its phrases count, so passes 1 and 2 lose none; pass 3 is exact. The fingerprints that
stayed go to the tasks as a bit array of 2**FILTER_BITS bits, whatever their number: a run that hits by chance is only
counted in vain. (Where phrases are so many that the array fills up, raise filter_bits.) Text itself is never shuffled,
and all sums combine before the shuffle, so a phrase or a language with a third of all rows is one row for each task.

A phrase is scored at the cut that explains it best: floor(1000 * a * n / (l * r)), least over the cuts, with its count a,
the counts l and r of the two sides and n words in all; products are decimals of 38 digits (a * n below 1e34).

Null text counts as empty, a null language as `und`; rows that repeat count again. An empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblode.llm.common import quoted, staged
from joblode.llm.near_dedup import mix
from joblode.llm.parts import byte_parts

LEAST, LONGEST, TOP = 100, 5, 2000
FILTER_BITS = 27
FEW_LANGS = 10_000
UNKNOWN = "und"
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
PASS_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_END = b"\xff"  # in no UTF-8 text
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\t", bytes(range(97, 123)) + _END * len(PIECE_ENDS) + b" ")


class Runs:
    """The words of some texts of several languages, and the fingerprints of their runs."""

    def __init__(self, texts: list[bytes], langs: list[str], ids: list) -> None:
        flat: list[bytes] = []
        sizes = []
        for text in texts:
            words = text.translate(_CLEAN).replace(_END, b" \xff ").split()
            sizes.append(len(words) + 1)
            flat += words
            flat.append(_END)
        codes, self.names = pd.factorize(np.array(flat, dtype=object))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        is_end = np.array([name == _END for name in self.names], bool)[codes] if len(codes) else np.zeros(0, bool)
        ends = np.nonzero(is_end)[0]
        next_end = ends[np.searchsorted(ends, np.arange(len(codes)))] if len(codes) else ends
        solid = np.nonzero(~is_end)[0]
        self.codes, self.room = codes, next_end - np.arange(len(codes))
        self.at = solid
        self.langs = list(dict.fromkeys(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([number[lang] for lang in langs], np.int64)[text_of] if len(codes) else np.zeros(0, np.int64)
        known = [i is not None for i in ids]
        self.ids = np.array([i if ok else 0 for i, ok in zip(ids, known, strict=True)], np.int64)[text_of]
        self.has_id = np.array(known, bool)[text_of]
        seeds = np.array([xxhash.xxh3_64_intdigest(lang.encode(), seed=1) for lang in self.langs], np.uint64)
        self.seed = seeds[self.lang] if len(codes) else np.zeros(0, np.uint64)
        hashes = np.array([xxhash.xxh3_64_intdigest(name) for name in self.names], np.uint64)
        word = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
        self.up, down = _powers(_BASE, len(codes)), _powers(_INVERSE, len(codes))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * down)])

    def starts(self, width: int) -> np.ndarray:
        """Places where a run of `width` words begins."""
        return self.at[self.room[self.at] >= width]

    def prints(self, at: np.ndarray, width: int) -> np.ndarray:
        """Fingerprints of the runs of `width` words that begin there; they tell languages and widths apart."""
        gram = (self.prefix[at + width] - self.prefix[at]) * self.up[at]
        return mix(gram + mix(self.seed[at] + np.uint64(width)))

    def counted(self, at: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Distinct fingerprints, their counts, and the smallest id of a text that holds them."""
        order = np.lexsort((self.ids[at], ~self.has_id[at], prints))
        at, prints = at[order], prints[order]
        first = np.nonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))[0] if len(prints) else np.zeros(0, np.int64)
        return prints[first], np.diff(np.append(first, len(prints))), pa.array(self.ids[at[first]], mask=~self.has_id[at[first]])


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def _places(prints: np.ndarray, bits: int) -> np.ndarray:
    return (prints >> np.uint64(64 - bits)).astype(np.int64)


def may_hold(words: np.ndarray, prints: np.ndarray, bits: int) -> np.ndarray:
    at = _places(prints, bits)
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def bit_words(kept: DataFrame, bits: int) -> np.ndarray:
    """Bit array of the fingerprints; at most 2**(bits - 6) words reach the driver."""
    place = F.shiftrightunsigned("print", 64 - bits)
    words = kept.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(%s as int))" % f"shiftrightunsigned(print, {64 - bits}) & 63").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return out


def count_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: int = LEAST, longest: int = LONGEST,
    filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, width, phrase, a, doc_id): phrases up to `longest` words that occur `least` times, with the smallest id of
    a document that holds each; and (lang, n): words in all."""
    spark = docs.sparkSession
    rows = docs.select(
        quoted(doc_id).cast("long").alias("id"), F.coalesce(quoted(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        quoted(text).cast("string").cast("binary").alias("body"),
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
        for batch in batches:
            for part, texts in byte_parts(batch, "body", PASS_BYTES):
                with np.errstate(over="ignore"):
                    yield Runs(texts, part.column("lang").to_pylist(), part.column("id").to_pylist())

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches):
            for width in (1, 2)[:longest]:
                at = own.starts(width)
                yield _counts(*own.counted(at, own.prints(at, width)))

    sums = "print long, n long, id long"
    kept = staged(_summed(rows.mapInArrow(short, sums), least), "frequent-pairs")
    shared = spark.sparkContext.broadcast(bit_words(kept, filter_bits))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches):
            for width, at in _chained(own, shared.value, filter_bits, longest):
                if width > 2:
                    yield _counts(*own.counted(at, own.prints(at, width)))

    kept = kept.unionByName(staged(_summed(rows.mapInArrow(long, sums), least), "frequent-runs"))
    frequent = spark.sparkContext.broadcast(bit_words(kept, filter_bits))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches):
            yield from _spelled(own, shared.value, frequent.value, filter_bits, longest)

    spelled = rows.mapInArrow(spell, "lang string, width int, phrase string, n long, id long")
    found = spelled.groupBy("lang", "width", "phrase").agg(F.sum("n").alias("a"), F.min("id").alias("doc_id"))
    found = staged(found.where((F.col("a") >= least) | (F.col("width") == 0)), "phrases")
    words = found.where("width = 0").select("lang", F.col("a").alias("n"))
    return found.where("width > 0"), words


def _counts(prints: np.ndarray, n: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n, pa.int64()), ids], names=["print", "n", "id"])


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("print").agg(F.sum("n").alias("n"), F.min("id").alias("id")).where(F.col("n") >= least)


def _chained(own: Runs, pairs: np.ndarray, bits: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each width from two on the places of runs all of whose pairs may be frequent."""
    at = own.starts(2)
    open_ = np.zeros(len(own.codes) + longest, bool)
    open_[at] = may_hold(pairs, own.prints(at, 2), bits)
    at = at[open_[at]]
    for width in range(2, longest + 1):
        if width > 2:
            at = at[(own.room[at] >= width) & open_[at + width - 2]]
        yield width, at


def _spelled(own: Runs, pairs: np.ndarray, frequent: np.ndarray, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the literal phrases whose fingerprints stayed, and of all words (width 0) by language."""
    total = np.bincount(own.lang[own.at], minlength=len(own.langs))
    seen = [i for i, n in enumerate(total) if n]
    yield _phrases([own.langs[i] for i in seen], 0, [""] * len(seen), total[seen], pa.nulls(len(seen), pa.int64()))
    base = len(own.names) + 1
    for width, at in [(1, own.at), *_chained(own, pairs, bits, longest)]:
        if width > longest:
            return
        at = at[may_hold(frequent, own.prints(at, width), bits)]
        key = own.lang[at]
        for j in range(width):
            key, _ = pd.factorize(key * base + own.codes[at + j])
        order = np.lexsort((own.ids[at], ~own.has_id[at], key))
        at, key = at[order], key[order]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        start = at[first]
        words = [b" ".join([own.names[c] for c in own.codes[s : s + width]]).decode() for s in start.tolist()]
        yield _phrases([own.langs[i] for i in own.lang[start].tolist()], width, words, np.diff(np.append(first, len(key))), pa.array(own.ids[start], mask=~own.has_id[start]))


def _phrases(langs: list[str], width: int, words: list[str], n: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array([width] * len(langs), pa.int32()), pa.array(words, pa.string()), pa.array(n, pa.int64()), ids],
        names=["lang", "width", "phrase", "n", "id"],
    )


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(17,0)")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: int = LEAST, longest: int = LONGEST,
    top: int | None = TOP, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, doc_id (an example): the first `top` phrases of each language.

    A phrase that lies in a longer one that occurs as often is left out.
    """
    counts, words = count_phrases(docs, text, lang, doc_id, least, longest, filter_bits)
    if words.count() <= FEW_LANGS:  # then no language is a hot key of a join
        words = F.broadcast(words)
    phrases = counts.where("width >= 2")
    cuts = phrases.withColumn("w", F.split("phrase", " ")).select(
        "lang", "phrase", "width", "a", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("width") - 1), lambda k: F.struct(
            F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.col("width") - k), " ").alias("right"),
        ))).alias("k", "side")
    ).select("lang", "phrase", "width", "a", "doc_id", "k", "side.left", "side.right")
    side = counts.select("lang", "phrase", "a")
    both = cuts.join(side.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(
        side.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]
    ).join(words, "lang")
    both = both.withColumn("top", _wide("a") * _wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", _wide("l") * _wide("r"))
    scored = both.withColumn("score", F.expr("top div under")).groupBy("lang", "phrase").agg(
        F.first("width").alias("width"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("doc_id").alias("doc_id"),
        F.min(F.struct("score", "k", "l", "r")).alias("cut"),
    )
    # a longer phrase that counts as much holds one that is one word longer and counts as much too
    parts = phrases.where("width > 2").select(
        "lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', width - 1)"), F.expr("substring_index(phrase, ' ', 1 - width)"))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = scored.join(parts, ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = alone.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "doc_id")
