"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Texts are split by the vocabulary's pattern. The distinct pieces of a batch that are no tokens themselves go into
padded numpy matrices by length: in each round every row merges its leftmost pair of lowest rank, found by a hashed
pair table, and rows shrink by one; finished rows leave the matrix. Pieces longer than MATRIX_BYTES take the same
merges from a heap, which costs n log n. Batches are independent: no shuffle, no state beyond a bounded cache.

Null text counts as empty: no tokens. Every row of the input gives one row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from joblode.llm.common import quoted

MATRIX_BYTES = 1024
MATRIX_CELLS = 1 << 18
CACHED_CHUNKS = 150_000
CACHED_CHARS = 4_000_000
BATCH_CHARS = 500_000
NONE = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token; open addressing in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        place = self._home(keys)
        while len(keys):
            free = self.keys[place] == np.uint64(2**64 - 1)
            spots, first = np.unique(np.where(free, place, -1), return_index=True)
            first = first[spots >= 0]
            self.keys[place[first]], self.values[place[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, place = keys[left], values[left], (place[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where a pair (or a padding of -1) does not merge."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.uint64) << np.uint64(32) | right[at].astype(np.uint64)
        place, found, open_ = self._home(keys), np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        while len(open_):
            seen = self.keys[place]
            hit = seen == keys[open_]
            found[open_[hit]] = self.values[place[hit]]
            more = ~hit & (seen != np.uint64(2**64 - 1))
            open_, place = open_[more], (place[more] + 1) & ((1 << self.bits) - 1)
        out[at] = found
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.split = regex.compile(pattern).findall
        self.spaces = regex.compile(r"\s\s").search
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        size = max(ranks.values(), default=-1) + 1
        words = [b""] * size
        for token, rank in ranks.items():
            words[rank] = token
        self.token_len = np.array([len(w) for w in words] or [0], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.weight = 0
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            elif len(piece) > MATRIX_BYTES:
                out[i] = self._merge_long(piece)
            else:
                by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in sorted(by_width.items()):
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(rows), step):
                self._merge_matrix(rows[k : k + step], pieces, width, out)
        return out

    def _merge_matrix(self, which: list[int], pieces: list[bytes], width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in which), np.uint8).reshape(len(which), width)
        length = np.array([len(pieces[i]) for i in which])
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        owner, rank = np.array(which), self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        while len(owner):
            best = rank.argmin(1)
            row = np.arange(len(owner))
            low = rank[row, best]
            done = low == NONE
            if done.any():
                for i, tokens, n in zip(owner[done], ids[done], length[done], strict=True):
                    out[i] = tokens[:n].copy()
                keep = ~done
                ids, rank, owner, length, best, low = ids[keep], rank[keep], owner[keep], length[keep], best[keep], low[keep]
                if not len(owner):
                    break
                row = np.arange(len(owner))
                most = int(length.max())
                ids, rank = ids[:, :most], rank[:, : max(1, most - 1)]
            ids[row, best] = low
            stay = np.ones(ids.shape, bool)
            stay[row, best + 1] = False
            ids = ids[stay].reshape(len(owner), -1)
            length = length - 1
            if ids.shape[1] == 1:
                rank = np.full((len(owner), 1), NONE, np.int32)
                continue
            stay = np.ones(rank.shape, bool)
            stay[row, best] = False
            rank = rank[stay].reshape(len(owner), -1)
            left = best > 0
            rank[row[left], best[left] - 1] = self.pairs.look_up(ids[row[left], best[left] - 1], ids[row[left], best[left]])
            right = best < rank.shape[1]
            rank[row[right], best[right]] = self.pairs.look_up(ids[row[right], best[right]], ids[row[right], best[right] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pairs.look_up(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.nonzero(first != NONE)[0]]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        ask = lambda i, j: int(self.pairs.look_up(np.array([ids[i]]), np.array([ids[j]]))[0])
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ask(i, j) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (new := ask(i, after[i])) != NONE:
                    heapq.heappush(heap, (new, i))
            if before[i] >= 0 and (new := ask(before[i], i)) != NONE:
                heapq.heappush(heap, (new, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks that the cache lacks."""
        pieces = [[p.encode() for p in self.split(c)] for c in chunks]
        place = {p: i for i, p in enumerate(dict.fromkeys(p for ps in pieces for p in ps))}
        merged = self.merge(list(place))
        ids = [np.concatenate([merged[place[p]] for p in ps]) if ps else np.zeros(0, np.int32) for ps in pieces]
        sizes = np.array([len(x) for x in ids], np.int64)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, *ids])
        for c in chunks:
            self.chunks[c] = len(self.chunks)
            self.weight += len(c)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text.

        A blank between two characters that are not white space always starts a piece, so such texts are cut there
        first and equal chunks are encoded once; texts with white space in a row are one chunk.
        """
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.spaces(text) or text[0].isspace():
                own = [text]
            else:
                first, *rest = text.split(" ")
                own = [first, *[" " + c for c in rest]]
            counts[i] = len(own)
            chunks += own
        if len(self.chunks) > CACHED_CHUNKS or self.weight > CACHED_CHARS:
            self._clear()
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        ids = gather(self.pool, self.starts[at], self.sizes[at])
        ends = np.concatenate([[0], np.cumsum(self.sizes[at])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids."""
        sizes = self.token_len[ids]
        data = gather(self.token_bytes, self.token_at[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return pool[shift + np.arange(total)]


def by_size(batch: pa.RecordBatch, column: str, limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with at most so many characters (or one row), and the texts; null texts are empty."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, own in enumerate([*sizes, limit + 1]):
        if i > start and size + own > limit:
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start, size = i, 0
        size += own


_codecs: dict[str, Codec] = {}


def _codec(name: str, shared: Broadcast) -> Codec:
    """The worker's codec for this vocabulary; a worker keeps one."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(*shared.value)
    return _codecs[name]


OUTPUTS = {
    "n_tokens": ("long", pa.int64()), "token_ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()),
    "decoded": ("binary", pa.binary()), "decoded_sha256": ("string", pa.string()),
}


def tokenize(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """Encode every text, decode it again, and return the columns `keep` with the `outputs` asked for.

    vocabulary: path of the rank file on the driver (its size is fixed; it is broadcast). outputs: n_tokens,
    token_ids, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded (bytes), decoded_sha256. A column to
    keep that has the name of an output is replaced by it.
    """
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    keep = tuple(c for c in keep if c.lower() not in outputs)
    rows = docs.select(*(quoted(c) for c in keep), quoted(text).cast("string").alias("__text"))
    fields = rows.schema.fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{o} {OUTPUTS[o][0]}" for o in outputs])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared)
        for batch in batches:
            for part, texts in by_size(batch, "__text"):
                ids, counts = codec.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                decoded = codec.decode(ids, counts) if any(o.startswith("decoded") for o in outputs) else []
                made = {"n_tokens": counts, "decoded": decoded}
                if "token_ids" in outputs:
                    made["token_ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                if "ids_sha256" in outputs:
                    raw = ids.astype("<u4").tobytes()
                    made["ids_sha256"] = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                if "decoded_sha256" in outputs:
                    made["decoded_sha256"] = [hashlib.sha256(d).hexdigest() for d in decoded]
                columns = [part.column(f.name) for f in fields] + [x if isinstance(x := made[o], pa.Array) else pa.array(x, OUTPUTS[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + list(outputs))

    return rows.mapInArrow(encode, schema)
