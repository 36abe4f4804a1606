"""Runs of words that repeat with a period, found by recursive frequency splitting and a scan of lags.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(MIN_WORDS, MIN_PERIODS * q)
long, that no neighbouring word extends. Each word of a run occurs at least MIN_PERIODS times in it. So within a
segment (a whole text at first) every word that occurs less often splits it; the pieces are counted anew until none
changes, all segments of a batch at once. What survives is scanned lag by lag: a run of period q covers two
neighbouring blocks of q words, cut at multiples of q, that both equal their successor. Blocks are compared by prefix
polynomials, which costs length / q for a lag; the stretch around a hit is then compared word by word. A stretch inside
a run that is known by a divisor of the lag is that run again and is passed over.

Null text counts as empty: no runs, an empty collapsed text. Each row of the input gives one row (repeated rows each
their own); a kept column that has the name of an output is replaced by it. Work on a text of n words is about
n log n behind the splitting; a task holds one part of about a million bytes, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from joblode.llm.near_dedup import mix
from joblode.llm.parts import byte_parts, ddl, number_words, true_runs, with_bytes

MIN_WORDS, MIN_PERIODS = 6, 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split(codes: np.ndarray, sizes: np.ndarray, least: int = MIN_PERIODS, shortest: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (places in codes) of the segments in which every word occurs at least `least` times."""
    width = int(codes.max(initial=0)) + 1
    place, label = np.arange(len(codes)), np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = [], []
    while len(place):
        pairs, _ = pd.factorize(label * width + codes[place])
        often = np.bincount(pairs)[pairs] >= least
        changed = np.zeros(int(label[-1]) + 1, bool)
        changed[label[~often]] = True
        still = ~changed[label]
        cut = np.nonzero(np.diff(label[still]))[0]
        settled = place[still]
        if len(settled):
            starts.append(np.concatenate([settled[:1], settled[cut + 1]]))
            ends.append(np.concatenate([settled[cut], settled[-1:]]) + 1)
        again = often & ~still
        place, label = place[again], label[again]
        if not len(place):
            break
        fresh = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(label) != 0)])
        label = np.cumsum(fresh) - 1
        long_enough = (np.bincount(label) >= shortest)[label]
        place, label = place[long_enough], label[long_enough]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(first)
    first, last = first[order], last[order]
    keep = last - first >= shortest
    return first[keep], last[keep]


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def scan(codes: np.ndarray, least: int = MIN_PERIODS, shortest: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in one segment."""
    n = len(codes)
    with np.errstate(over="ignore"):
        up, down = _powers(_BASE, n), _powers(_INVERSE, n)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * down)])
    found: list[tuple[int, int, int]] = []
    known = np.zeros((0, 3), np.int64)
    for lag in range(1, n // least + 1):
        need = max(shortest, least * lag) - lag
        blocks = n // lag
        at = prefix[: blocks * lag + 1 : lag]
        block = (at[1:] - at[:-1]) * up[: blocks * lag : lag]
        same = block[1:] == block[:-1]
        if not (same[1:] & same[:-1]).any():
            continue
        for k, end in zip(*true_runs(same), strict=True):
            if end - k < 2:
                continue
            inside = (known[:, 0] <= k * lag) & (known[:, 1] >= (end + 1) * lag) & (lag % np.maximum(known[:, 2], 1) == 0)
            if inside.any():
                continue
            lo, hi = max(0, (k - 1) * lag), min(n, (end + 2) * lag)
            for a, b in zip(*true_runs(codes[lo : hi - lag] == codes[lo + lag : hi]), strict=True):
                if b - a >= need:
                    found.append((int(lo + a), int(b - a + lag), lag))
        if len(found) > len(known):
            known = np.array([(s, s + length, q) for s, length, q in found], np.int64)
    return found


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = MIN_PERIODS, shortest: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period; starts count words of the text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    edges = np.cumsum(sizes)
    for a, b in zip(*split(codes, sizes, least, shortest), strict=True):
        text = int(np.searchsorted(edges, a, side="right"))
        shift = int(a - (edges[text] - sizes[text]))
        out[text] += [(s + shift, length, q) for s, length, q in scan(codes[a:b], least, shortest)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d)


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = MIN_PERIODS, shortest: int = MIN_WORDS) -> DataFrame:
    """The columns to keep, n_words, runs (array of start, length, period) and collapsed (the text without repeats)."""
    if least < 4 or shortest < least:
        raise ValueError("a run needs four periods at least, and no less words than periods")
    keep = tuple(c for c in keep if c.lower() not in ("n_words", "runs", "collapsed"))
    rows, body = with_bytes(docs, text, keep)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_parts(batch, body):
                flat, codes, sizes, _ = number_words(texts)
                runs = runs_of(codes, sizes, least, shortest)
                ends = np.cumsum(sizes).tolist()
                collapsed = [collapse(flat[e - n : e], own) for e, n, own in zip(ends, sizes.tolist(), runs, strict=True)]
                line = [r for own in runs for r in own]
                flat_runs = pa.StructArray.from_arrays([pa.array([r[i] for r in line], pa.int64()) for i in range(3)], fields=list(RUN))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in runs])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat_runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=[*part.schema.names[:-1], "n_words", "runs", "collapsed"],
                )

    schema = ", ".join(filter(None, [ddl(rows, tuple(rows.columns[:-1])), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"]))
    return rows.mapInArrow(search, schema)
