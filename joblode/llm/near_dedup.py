"""Near-duplicate texts by weighted Jaccard similarity of word shingles: BagMinHash signatures, bands, exact overlap.

A text is the multiset of its shingles: runs of five lower-cased words cut at white space; a shorter text is one
shingle. Each shingle owns Poisson processes over weight and time. The weight axis is cut into unit levels, and the
levels into octaves [0,1), [1,2), [2,4), [4,8) ...; an octave is one process with a rate of its width. A point of it
gets a register, and its level by halving the octave; it counts if that level is below the shingle's weight. So equal
shingles share exactly the points below the smaller weight, and two registers agree with the probability of the
weighted Jaccard similarity. Points come in rising order, and a process ends behind the largest register, so a text
costs about its length plus m log m points.

Registers are banded (BANDS of ROWS: a pair at 0.8 is missed with a probability of 3e-5); pairs that share a band and
whose signatures do not rule out the threshold by five deviations are held against the exact multiset overlap.

Texts with equal words are one item. Null text counts as empty, and empty texts are copies of each other. Rows that
share an id are one document. A null id has no class (class_id null) and stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.bpe import BATCH_CHARS, by_size
from joblode.llm.buckets import candidates, links, numbered, smallest_ids
from joblode.llm.common import attach, fresh, quoted, staged, with_columns_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times_g(n: int) -> np.uint64:
    return np.uint64(n * int(_G) & 0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[str], width: int = WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Key of each text's words; then of all texts in a row: owner, distinct shingle hashes (sorted in a text), counts."""
    words = [t.lower().split() for t in texts]
    keys = [hashlib.sha256(" ".join(w).encode()).digest() for w in words]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    codes, names = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    # each text gets width - 1 blanks behind it; a text has max(1, words - width + 1) shingles
    pad = width - 1
    starts = np.cumsum(sizes + pad) - (sizes + pad)
    line = np.zeros(int((sizes + pad).sum()) + pad, np.uint64)
    line[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = hashes[codes] if flat else 0
    whole = np.zeros(len(line) - pad, np.uint64)
    for j in range(width):
        whole = mix(whole * _G + line[j : len(line) - pad + j] + np.uint64(j + 1))
    number = np.where(sizes > 0, np.maximum(1, sizes - pad), 0)
    at = np.repeat(starts - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
    taken, ends = whole[at], np.cumsum(number)
    for a, b in zip((ends - number).tolist(), ends.tolist(), strict=True):
        taken[a:b].sort()
    owner = np.repeat(np.arange(len(texts)), number)
    first = np.ones(len(taken), bool)
    first[1:] = (taken[1:] != taken[:-1]) | (owner[1:] != owner[:-1])
    begin = np.nonzero(first)[0]
    return keys, owner[begin], taken[begin], np.diff(np.append(begin, len(taken)))


def _all_shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, distinct shingle hashes and counts of many texts, read in parts of about BATCH_CHARS."""
    owners, elements, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    start = size = 0
    for i, text in enumerate([*texts, None]):
        if i > start and (text is None or size + len(text) > BATCH_CHARS):
            _, owner, element, weight = shingles(texts[start:i], width)
            owners.append(owner + start)
            elements.append(element)
            weights.append(weight)
            start, size = i, 0
        size += len(text or "")
    return np.concatenate(owners), np.concatenate(elements), np.concatenate(weights)


def signatures(number: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of each of `number` bags: the time of the first point that counts."""
    out = np.full(number * registers, np.inf)
    top = int(weight.max()).bit_length() if len(weight) else 0
    for octave in range(top + 1):
        start, width = (0, 1) if octave == 0 else (1 << octave - 1, 1 << octave - 1)
        on = weight > start
        if not on.any():
            break
        bag, bound = owner[on], weight[on]
        seed = mix(element[on] + _times_g(octave + 1))
        time, step = np.zeros(len(bag)), 0
        while len(bag):
            step += 1
            draw = mix(seed + _times_g(step))
            time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / width
            # the largest register only falls, so a process behind it is over
            go = time < out.reshape(number, registers).max(1)[bag]
            bag, bound, seed, time, draw = bag[go], bound[go], seed[go], time[go], draw[go]
            more = mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
            register = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            level = start + (((more >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
            counts = level < bound
            np.minimum.at(out, bag[counts] * registers + register[counts], time[counts])
    return out.reshape(number, registers)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted distinct elements, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    both = int(a[1].sum() + b[1].sum()) - common
    return common / both if both else 1.0


def _judge(threshold: float, width: int):
    least = REGISTERS * threshold - 5 * np.sqrt(REGISTERS * threshold * (1 - threshold))

    def prepare(frame: pd.DataFrame):
        ids, texts = frame["id"].to_numpy(), frame["text"].to_numpy()
        place: dict = {}
        slot = np.array([place.setdefault((i, t), len(place)) for i, t in zip(ids, texts, strict=True)])
        owner, element, weight = _all_shingles([t for _, t in place], width)
        _, element = np.unique(element, return_inverse=True)
        bounds = np.searchsorted(owner, np.arange(len(place) + 1))
        total = np.bincount(owner, weight, len(place))[slot]
        signature = np.stack([np.frombuffer(s, np.uint32) for s in frame["signature"]])
        dense = np.zeros(int(element.max(initial=0)) + 1, np.int64)

        def ask(a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> np.ndarray:
            open_ = open_ & (np.minimum(total[a][:, None], total[b]) >= threshold * np.maximum(total[a][:, None], total[b]) - 1e-9)
            linked = np.zeros(open_.shape, bool)
            group = {int(r): i for i, r in enumerate(dict.fromkeys([*a.tolist(), *b.tolist()]))}
            label = np.arange(len(group))
            ga, gb = np.array([group[r] for r in a.tolist()]), np.array([group[r] for r in b.tolist()])
            for i in range(len(a)):
                near = np.nonzero(open_[i])[0]
                near = near[(signature[b[near]] == signature[a[i]]).sum(1) >= least]
                near = near[label[gb[near]] != label[ga[i]]]  # known to be in one class already
                if not len(near):
                    continue
                own = slice(*bounds[[slot[a[i]], slot[a[i]] + 1]])
                dense[element[own]] = weight[own]
                runs = [slice(*bounds[[s, s + 1]]) for s in slot[b[near]]]
                sizes = np.array([r.stop - r.start for r in runs])
                common = np.minimum(dense[np.concatenate([element[r] for r in runs])], np.concatenate([weight[r] for r in runs]))
                common = np.add.reduceat(common, np.cumsum(sizes) - sizes)
                dense[element[own]] = 0
                hit = near[common >= threshold * (total[a[i]] + total[b[near]] - common) - 1e-9]
                linked[i, hit] = True
                for g in set(label[gb[hit]].tolist()):
                    label[label == g] = label[ga[i]]
            return linked

        return ask

    return prepare


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of the class), kept, copies (rows with equal words)."""
    rows = docs.select(quoted(doc_id).cast("long").alias("own_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_size(batch, "text"):
                keys, owner, element, weight = shingles(texts, width)
                found = signatures(len(texts), owner, element, weight).view(np.uint64)
                bands = np.zeros((len(texts), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands * _G + found[:, r::ROWS] + np.uint64(r))
                full = np.bincount(owner, minlength=len(texts)) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))])
                hashes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[full].view(np.int64).ravel()), mask=pa.array(~full))
                short = (mix(found) >> np.uint64(32)).astype(np.uint32)
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * REGISTERS), len(texts), [None, pa.py_buffer(short.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("own_id"), part.column("text_hash"), pa.array(keys, pa.binary()), hashes, whole.cast(pa.binary())],
                    names=["own_id", "text_hash", "key", "hashes", "signature"],
                )

    signed = staged(rows.mapInArrow(sign, "own_id long, text_hash long, key binary, hashes array<long>, signature binary"), "signatures")
    good = signed.where("own_id is not null")
    groups = staged(good.groupBy("key").agg(F.min("own_id").alias("own_id"), F.count("*").alias("n")), "groups")
    # an item is the words of a text with their smallest id; an id may stand for several, so items have numbers of their own
    items = numbered(signed.join(groups, ["own_id", "key"]).dropDuplicates(["own_id", "key"]), "items")
    met = staged(candidates(items).join(items.select("id", "own_id", "text_hash", "signature"), "id"), "candidates")
    place = ["own_id", "text_hash"]
    texts = rows.join(met, place, "left_semi").dropDuplicates(place)
    found = links(items.join(met, "id", "left_semi"), met.join(texts, place).select("id", "signature", "text"), _judge(threshold, width))
    found = staged(found.unionByName(_tied(good, items)), "links")
    known = staged(smallest_ids(items.select("id", "own_id", "key", "n"), found).select("key", "n", F.col("smallest").alias("class_id")), "classes")
    named = attach(good.select(F.col("own_id").alias("doc_id"), "key"), known, "key", "n", signed.count())
    named = named.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"), F.col("n").alias("copies"))
    return named.unionByName(
        signed.where("own_id is null").select(
            F.col("own_id").alias("doc_id"), F.col("own_id").alias("class_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("copies")
        )
    )


def _tied(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Links between the items that rows of one id fall into: such rows are one document."""
    several = rows.groupBy("own_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("own_id")
    tied = rows.join(several, "own_id", "left_semi").select("own_id", "key").distinct().join(items.select("id", "key"), "key")
    first = tied.groupBy("own_id").agg(F.min("id").alias("a"))
    edges = tied.join(first, "own_id").where("a <> id")
    return edges.select("a", F.col("id").alias("b"), F.lit(0).cast("long").alias("n"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """docs without the near copies: of each class the smallest doc_id stays."""
    (gone,) = fresh(docs, "gone_id")
    losers = staged(near_classes(docs, doc_id, text, threshold, width).where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "near-copies")
    return with_columns_of(docs.join(losers, quoted(doc_id).cast("long") == F.col(gone), "left_anti"), docs.columns)
