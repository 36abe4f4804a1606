"""Language-model scores by deleted interpolation of word n-grams.

Tokens are the words between ASCII white space, A-Z lowered, and one end for each text. The probability of a token is
  a(b) c(prev, w) / c(prev) + m(b) c(w) / N + z(b) / (V + 1)
with weights for each bucket b of the context's frequency (powers of two). The weights are learned by expectation
maximisation on held-out counts: a second hash of the id deletes one in FOLDS of the training documents from the
counts, and their tokens are judged by the counts of the others. The estimates themselves count all training documents.
Without a deleted document the weights are even ones.

Nothing is sampled or capped, and no table of n-grams is broadcast. A block of documents (about BLOCK_TOKENS tokens)
sends its distinct n-gram hashes (64 bits) with its training counts to the owners of the hash ranges; owners add up
and send totals back in the order of the block's hashes. Each hash travels once for a block, packed in arrays; the
number of ranges grows with the tokens, so an owner holds about RANGE_TOKENS hashes. What reaches the driver is a
histogram of count ratios: it has a fixed number of cells.

Null text counts as empty (one end token). A null id is not held out. Repeated rows are texts of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm.bpe import by_size
from joblode.llm.common import quoted, staged
from joblode.llm.near_dedup import mix

BLOCK_TOKENS = 500_000
RANGE_TOKENS = 1_000_000
BUCKETS = 48
STEPS = 4  # of the histogram for a doubling
EM_ROUNDS = 200
FOLDS = 8
END = b" "  # no word holds a blank
_G = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x5851F42D4C957F2D)
FLAGS = "named array<boolean>, held array<boolean>, deleted array<boolean>"
BLOCK = f"block string, ids binary, sizes array<long>, {FLAGS}, vocabulary binary, words binary, train long, starts long, deleted_tokens long, deleted_starts long"


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, equal places together, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    ids, sizes, held, flat = [], [], [], []
    for batch in batches:
        for part, texts in by_size(batch, "text"):
            for doc, out, text in zip(part.column("id").to_pylist(), part.column("held").to_pylist(), texts, strict=True):
                words = text.encode().lower().split()
                ids.append(doc)
                held.append(out)
                sizes.append(len(words) + 1)
                flat += words
                flat.append(END)
            if len(flat) >= block_tokens:
                yield _block(ids, sizes, held, flat)
                ids, sizes, held, flat = [], [], [], []
    if ids:
        yield _block(ids, sizes, held, flat)


def _block(ids: list, sizes: list, held: list, flat: list[bytes]) -> pa.RecordBatch:
    codes, names = pd.factorize(np.array(flat, dtype=object))
    vocabulary = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    size, train, named = np.array(sizes), ~np.array(held, bool), [i is not None for i in ids]
    out = deleted(ids) & train
    sums = [int(size[train].sum()), int(train.sum()), int(size[out].sum()), int(out.sum())]
    packed = pack(np.array([i or 0 for i in ids], np.int64))
    row = [uuid.uuid4().hex, packed, sizes, named, held, out.tolist(), pack(vocabulary), pack(codes.astype(np.uint32)), *sums]
    types = [pa.string(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.bool_())] * 3, pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])


def deleted(ids: list) -> np.ndarray:
    """Which documents the weights are learned on, if they are training documents; a null id is none."""
    return np.array([i is not None and xxhash.xxh3_64_intdigest(str(i), seed=1) % FOLDS == 0 for i in ids], bool)


def _keys(vocabulary: bytes, words: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct n-gram hashes (odd: words, even: pairs), where each word and each pair of the block stands among them,
    and the words' codes."""
    names, codes = unpack(vocabulary, np.uint64), unpack(words, np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    before = np.empty(len(codes), np.uint64)
    before[1:] = names[codes[:-1]]
    before[ends - sizes] = _START
    pairs = mix(before * _G + names[codes]) & ~np.uint64(1)
    singles = names | np.uint64(1)
    hashes, place = np.unique(np.concatenate([singles, pairs]), return_inverse=True)
    return hashes, place[: len(names)], place[len(names) :], codes


def _send(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"])
                hashes, single, pair, codes = _keys(row["vocabulary"], row["words"], sizes)
                counts, without = (
                    np.bincount(np.concatenate([single[codes[on]], pair[on]]), minlength=len(hashes)).astype(np.uint32)
                    for on in (np.repeat(~np.array(row["held"], bool), sizes), np.repeat(np.array(row["deleted"], bool), sizes))
                )
                owner = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                owners, first = np.unique(owner, return_index=True)
                bounds = [*first.tolist(), len(hashes)]
                out = []
                for i, a in enumerate(bounds[:-1]):
                    piece = hashes[a : bounds[i + 1]]
                    out.append((int(owners[i]), row["block"], pack(np.diff(piece, prepend=np.uint64(0))), pack(counts[a : bounds[i + 1]]), pack(without[a : bounds[i + 1]])))
                types = [pa.int64(), pa.string(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    names=["owner", "block", "hashes", "counts", "deleted"],
                )

    return send


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of an owner's hashes for each block; the row without a block has the number of distinct words."""
    pieces = [np.cumsum(unpack(h, np.uint64), dtype=np.uint64) for h in frame["hashes"]]
    hashes, place = np.unique(np.concatenate(pieces), return_inverse=True)
    totals, without = (
        np.bincount(place, np.concatenate([unpack(c, np.uint32) for c in frame[name]]), len(hashes)).astype(np.uint64)
        for name in ("counts", "deleted")
    )
    known = int(((totals > 0) & (hashes & np.uint64(1) == 1)).sum())
    ends = np.cumsum([len(p) for p in pieces])
    places = np.split(place, ends[:-1])
    owner = frame["owner"].iloc[0]
    out = pd.DataFrame(
        {"block": frame["block"], "owner": owner, "totals": [pack(totals[p]) for p in places], "deleted": [pack(without[p]) for p in places], "known": 0}
    )
    last = pd.DataFrame({"block": [""], "owner": [owner], "totals": [b""], "deleted": [b""], "known": [known]})
    return pd.concat([out, last], ignore_index=True)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket for each power of two."""
    return np.where(count > 0, np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1), 0)


def _ratio_cell(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        cell = np.rint(STEPS * np.log2(ratio)) + 128
    return np.where(ratio > 0, np.clip(cell, 1, 255), 0).astype(np.int64)


def _held_out_cells(c2: np.ndarray, c1: np.ndarray, context: np.ndarray, tokens: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of deleted tokens by bucket and the ratios of the two estimates, from the counts of the others, to the uniform one."""
    pair = c2 / np.maximum(context, 1) * (vocabulary + 1)
    single = c1 / max(tokens, 1) * (vocabulary + 1)
    cell = bucket(context) << 16 | _ratio_cell(pair) << 8 | _ratio_cell(single)
    return np.unique(cell, return_counts=True)


def learn_weights(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights (bucket x [pair, word, uniform]) by expectation maximisation; even ones where nothing was seen."""
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = 0, 0.5, 0.5
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(1, 256) - 128) / STEPS)])
    for b in np.unique(cells >> 16):
        on = cells >> 16 == b
        p = np.stack([ratio[cells[on] >> 8 & 255], ratio[cells[on] & 255], np.ones(on.sum())], 1)
        weight = out[b]
        for _ in range(EM_ROUNDS):
            part = p * weight
            part *= (counts[on] / part.sum(1))[:, None]
            weight = part.sum(0) / part.sum()
        out[b] = np.maximum(weight, 1e-9 * (weight > 0))
        out[b, 2] = max(out[b, 2], 1e-9)
        out[b] /= out[b].sum()
    return out


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(
        quoted(doc_id).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), quoted(text).cast("string").alias("text")
    )
    blocks = staged(rows.mapInArrow(lambda batches: _blocks(batches, block_tokens), BLOCK), "lm-blocks")
    every = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("train", "starts", "deleted_tokens", "deleted_starts", every))).first()
    tokens, starts, out_tokens, out_starts, every = (int(x) for x in sums)
    bits = max(0, (every // RANGE_TOKENS).bit_length())
    sent = blocks.mapInArrow(_send(bits), "owner long, block string, hashes binary, counts binary, deleted binary")
    totals = staged(sent.groupBy("owner").applyInPandas(_add_up, "block string, owner long, totals binary, deleted binary, known long"), "lm-totals")
    vocabulary = int(totals.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0])

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, right = [], right.sort_values("owner")
        total, without = (np.concatenate([unpack(t, np.uint64) for t in right[name]]).astype(np.int64) for name in ("totals", "deleted"))
        for row in left.itertuples():
            sizes = np.array(row.sizes)
            _, single, pair, codes = _keys(row.vocabulary, row.words, sizes)
            c1, c2 = total[single][codes], total[pair]
            rest1, rest2 = c1 - without[single][codes], c2 - without[pair]
            on = np.repeat(np.array(row.deleted, bool), sizes)
            cells, counts = _held_out_cells(rest2[on], rest1[on], _contexts(rest1, sizes, starts - out_starts)[on], tokens - out_tokens, vocabulary)
            out.append((row.ids, row.sizes, row.named, row.held, pack(c1), pack(c2), cells, counts))
        return pd.DataFrame(out, columns=["ids", "sizes", "named", "held", "c1", "c2", "cells", "counts"])

    counted = staged(
        blocks.groupBy("block").cogroup(totals.where("block <> ''").groupBy("block")).applyInPandas(
            answer, "ids binary, sizes array<long>, named array<boolean>, held array<boolean>, c1 binary, c2 binary, cells array<long>, counts array<long>"
        ),
        "lm-counts",
    )
    histogram = counted.select(F.explode(F.arrays_zip("cells", "counts")).alias("c")).groupBy("c.cells").agg(F.sum("c.counts").alias("n")).toPandas()
    weights = learn_weights(histogram["cells"].to_numpy(np.int64), histogram["n"].to_numpy(float))
    shared = spark.sparkContext.broadcast(weights)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"])
                c1, c2 = unpack(row["c1"], np.int64), unpack(row["c2"], np.int64)
                context = _contexts(c1, sizes, starts)
                b = bucket(context)
                p = w[b, 0] * c2 / np.maximum(context, 1) + w[b, 1] * c1 / max(tokens, 1) + w[b, 2] / (vocabulary + 1)
                first = np.cumsum(sizes) - sizes
                base = np.log10((c1 + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                add = lambda x, at=first: np.add.reduceat(x, at)
                ids = pa.array(unpack(row["ids"], np.int64), mask=~np.array(row["named"], bool))
                columns = [ids, row["held"], sizes, add((c1 > 0).astype(np.int64)), np.full(len(sizes), tokens), add(base), add(np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [c if c is ids else pa.array(c) for c in columns],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.select("ids", "sizes", "named", "held", "c1", "c2").mapInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _contexts(c1: np.ndarray, sizes: np.ndarray, starts: int) -> np.ndarray:
    """Training count of each token's context: the word before, or the start of a text."""
    out = np.empty_like(c1)
    out[1:] = c1[:-1]
    out[np.cumsum(sizes) - sizes] = starts
    return out
