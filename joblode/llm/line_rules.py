"""Quality rules over lines: a linear-chain conditional random field marks each line as content or boilerplate.

Lines are cut at \\n; only lines with a word count. A line is described by shares between 0 and 1 (letters, capitals,
digits, symbols, marks, words found in repeated three-word windows of its text, equal to an earlier line, the share of
such words in the whole text, ...). The field has one
weight for each feature and one for each pair of neighbouring labels; Viterbi decoding labels all lines of a text, and
the share of its words in content lines decides whether the text stays (KEEP_SHARE).

The field is trained here, on labelled documents: lines of good ones are content, lines of bad ones are boilerplate. The sample is bounded: TRAIN_DOCS documents of each label by the hash of the id, and
TRAIN_WINDOWS windows of WINDOW lines of them. Without labels there is no field, and all lines are content.

Null text counts as empty: no lines, all counts 0, content share 0. Each row gives one row, repeated rows each their own.
A kept column that has the name of an output is replaced by it. Ties in decoding go to content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.common import fresh, quoted, staged
from joblode.llm.parts import byte_parts, ddl, number_words, with_bytes

TRAIN_DOCS, TRAIN_WINDOWS, WINDOW = 1500, 2500, 32
STEPS, RATE, DECAY = 120, 0.15, 1e-3
KEEP_SHARE = 0.5
FEATURES = ["bias", "length", "letters", "capitals", "digits", "symbols", "marks", "exclaims", "bars", "stop", "repeated", "earlier", "echo"]
SYMBOLS = b"#*$%&|<>"


def _in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_BLANK = _in(b" \t\n\x0b\x0c\r")
_SYMBOL, _DIGIT, _UPPER = _in(SYMBOLS), _in(b"0123456789"), _in(bytes(range(65, 91)))
_LETTER = _UPPER | _in(bytes(range(97, 123))) | (np.arange(256) >= 0xC0)
_POINT = (np.arange(256) & 0xC0) != 0x80
_MARK = _POINT & ~_LETTER & ~_DIGIT & ~_BLANK
_STOP = _in(b".!?:;,\"')")


@dataclass
class Lines:
    """Counts of each text, and the lines with a word of all texts in a row."""

    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    earlier: np.ndarray
    repeated: np.ndarray
    owner: np.ndarray
    line_words: np.ndarray
    features: np.ndarray
    texts: list[bytes]


def repeated_words(codes: np.ndarray, sizes: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a window of `width` words that its text holds twice or more."""
    n = len(codes)
    hit = np.zeros(n, bool)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    at = np.nonzero(left >= width)[0]
    if not len(at):
        return hit
    base = int(codes.max()) + 1
    gram = np.repeat(np.arange(len(sizes)), sizes)[at]
    for j in range(width):
        gram, _ = pd.factorize(gram * base + codes[at + j])
    often = at[np.bincount(gram)[gram] > 1]
    for j in range(width):
        hit[often + j] = True
    return hit


def read_lines(texts: list[bytes]) -> Lines:
    """Counts and features of the texts."""
    number = len(texts)
    cut = [t.split(b"\n") for t in texts]
    per_text = np.array([len(c) for c in cut], np.int64)
    flat = [line for c in cut for line in c]
    sizes = np.array([len(line) for line in flat], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    points = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    owner = np.repeat(np.arange(number), per_text)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[starts + sizes] - total[starts]

    solid = ~_BLANK[points]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    line_words = count(begins).astype(np.int64)
    chars = count(_POINT[points] & solid)
    symbols = count(_SYMBOL[points])
    _, codes, word_sizes, _ = number_words(texts)
    hit = repeated_words(codes, word_sizes)
    hits = np.concatenate([[0], np.cumsum(hit)])
    upto = np.cumsum(line_words)
    line_hits = hits[upto] - hits[upto - line_words]
    names, _ = pd.factorize(np.array(flat + [None], dtype=object)[:-1])
    worded = line_words > 0
    earlier = np.zeros(len(flat), bool)
    key = pd.Series(owner[worded] * (len(flat) + 1) + names[worded])
    earlier[worded] = key.duplicated().to_numpy()
    last = points[np.maximum(starts + sizes - 1, 0)]
    every = np.maximum(chars, 1).astype(np.float64)
    letters = count(_LETTER[points])
    exclaims = count(points == 33)
    echo = (np.bincount(owner, line_hits, number) / np.maximum(word_sizes, 1))[owner]
    features = np.stack([
        np.ones(len(flat)), np.minimum(1, np.log2(1 + line_words) / 8), letters / every, count(_UPPER[points]) / np.maximum(letters, 1),
        count(_DIGIT[points]) / every, symbols / every, count(_MARK[points]) / every,
        np.minimum(1, exclaims / np.maximum(line_words, 1)), np.minimum(1, 2 * count(points == 124) / np.maximum(line_words, 1)),
        (sizes > 0) & _STOP[last], line_hits / np.maximum(line_words, 1), earlier, echo,
    ], 1)[worded]

    def by_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, number).astype(np.int64)

    return Lines(
        word_sizes, by_text(chars), by_text(symbols), by_text(earlier), by_text(line_hits), owner[worded], line_words[worded],
        features, [line for line, ok in zip(flat, worded.tolist(), strict=True) if ok],
    )


@dataclass
class Field:
    """weights: of the features, for content against boilerplate; steps[a, b]: from label a to label b (1 is content)."""

    weights: np.ndarray
    steps: np.ndarray


def viterbi(field: Field, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The best labels (True: content) of all lines; lines of one owner are a sequence."""
    n = len(owner)
    best = np.zeros(n, bool)
    if not n:
        return best
    content = features @ field.weights
    begin = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    length = np.diff(np.append(begin, n))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    came = np.zeros((n, 2), bool)
    score = np.stack([np.zeros(len(begin)), content[begin]], 1)
    active = len(begin)
    for t in range(1, int(length[0])):
        active = int(np.searchsorted(-length, -t, side="left"))
        at, now = begin[:active] + t, score[:active]
        into = now[:, :, None] + field.steps
        came[at] = into[:, 1] >= into[:, 0]
        score[:active] = into.max(1)
        score[:active, 1] += content[at]
    label = score[:, 1] >= score[:, 0]
    for t in range(int(length[0]) - 1, -1, -1):
        active = int(np.searchsorted(-length, -t, side="left"))
        at = begin[:active] + t
        best[at] = label[:active]
        label[:active] = came[at, label[:active].astype(np.int64)]
    return best


def likelihood(field: Field, features: np.ndarray, labels: np.ndarray, used: np.ndarray) -> tuple[float, Field]:
    """Mean log-likelihood of windows (window x line x feature; used: which lines exist) and its gradient."""
    windows, longest, _ = features.shape
    unary = np.zeros((windows, longest, 2))
    unary[:, :, 1] = features @ field.weights
    ahead, back = np.zeros((windows, longest, 2)), np.zeros((windows, longest, 2))
    ahead[:, 0] = unary[:, 0]
    for t in range(1, longest):
        into = np.logaddexp.reduce(ahead[:, t - 1, :, None] + field.steps, axis=1) + unary[:, t]
        ahead[:, t] = np.where(used[:, t, None], into, ahead[:, t - 1])
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    for t in range(longest - 2, -1, -1):
        out = np.logaddexp.reduce(field.steps + (unary[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        back[:, t] = np.where(used[:, t + 1, None], out, back[:, t + 1])
    chance = np.exp(ahead + back - total[:, None, None]) * used[:, :, None]
    pair = ahead[:, :-1, :, None] + field.steps + (unary + back)[:, 1:, None, :] - total[:, None, None, None]
    pair = np.exp(pair) * used[:, 1:, None, None]
    both = used[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    value = (unary[:, :, 1] * labels * used).sum() + (seen * field.steps).sum() - total.sum()
    slope = np.einsum("wlf,wl->f", features, (labels - chance[:, :, 1]) * used)
    return value / windows, Field(slope / windows, (seen - pair.sum((0, 1))) / windows)


def fit(features: np.ndarray, labels: np.ndarray, used: np.ndarray) -> Field:
    """Weights by gradient ascent with momentum and step sizes of their own (fixed number of steps)."""
    place = np.zeros(features.shape[2] + 4)
    speed, size = np.zeros_like(place), np.zeros_like(place)
    for step in range(1, STEPS + 1):
        _, slope = likelihood(Field(place[:-4], place[-4:].reshape(2, 2)), features, labels, used)
        slope = np.concatenate([slope.weights, slope.steps.ravel()]) - DECAY * place
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        place = place + RATE * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
    return Field(place[:-4], place[-4:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", good: str = "quality") -> Field | None:
    """The field, from labelled documents (labels: doc_id and good, 0 or 1; several labels of a document count as the least)."""
    marks = labels.where(quoted(doc_id).isNotNull() & quoted(good).isNotNull()).groupBy(quoted(doc_id).cast("long").alias("id")).agg(
        F.min(quoted(good).cast("int")).alias("good")
    )
    order = [F.xxhash64("id"), F.col("id")]
    chosen = marks.where("good > 0").orderBy(*order).limit(TRAIN_DOCS).unionByName(marks.where("good <= 0").orderBy(*order).limit(TRAIN_DOCS))
    (key,) = fresh(docs, "label_id")
    chosen = staged(chosen.select(F.col("id").alias(key), "good"), "labelled")
    rows = docs.join(F.broadcast(chosen), quoted(doc_id).cast("long") == F.col(key)).select(
        F.col(key).alias("id"), F.col("good"), quoted(text).cast("string").cast("binary").alias("body")
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_parts(batch, "body"):
                lines = read_lines(texts)
                bound = np.searchsorted(lines.owner, np.arange(len(texts) + 1))
                made = []
                for i, (doc, mark) in enumerate(zip(part.column("id").to_pylist(), part.column("good").to_pylist(), strict=True)):
                    for k, start in enumerate(range(bound[i], bound[i + 1], WINDOW)):
                        own = lines.features[start : min(start + WINDOW, bound[i + 1])].astype(np.float32)
                        made.append((doc, k, int(mark > 0), own.tobytes()))
                columns = list(zip(*made, strict=True)) or [[], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "window", "good", "features"])

    found = rows.mapInArrow(windows, "id long, window long, good int, features binary")
    sample = found.orderBy(F.xxhash64("id", "window"), "id", "window", "features").limit(TRAIN_WINDOWS).collect()
    if len({row.good for row in sample}) < 2:
        return None
    width = len(FEATURES)
    features, labels_, used = np.zeros((len(sample), WINDOW, width)), np.zeros((len(sample), WINDOW), np.int64), np.zeros((len(sample), WINDOW), bool)
    for i, row in enumerate(sample):
        own = np.frombuffer(row.features, np.float32).reshape(-1, width)
        features[i, : len(own)], used[i, : len(own)] = own, True
        labels_[i, : len(own)] = row.good
    return fit(features, labels_, used)


OUTPUTS = {
    "n_words": ("long", pa.int64()), "word_chars": ("long", pa.int64()), "n_symbols": ("long", pa.int64()), "n_dup_lines": ("long", pa.int64()),
    "n_repeat_words": ("long", pa.int64()), "n_lines": ("long", pa.int64()), "n_content_lines": ("long", pa.int64()),
    "content_share": ("double", pa.float64()), "content": ("string", pa.string()),
}


def label_lines(
    docs: DataFrame, field: Field | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_share"),
) -> DataFrame:
    """The columns to keep with the outputs asked for; content is the text made of the content lines alone."""
    keep = tuple(c for c in keep if c.lower() not in outputs)
    rows, body = with_bytes(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for part, texts in byte_parts(batch, body):
                lines, number = read_lines(texts), len(texts)
                good = viterbi(field, lines.features, lines.owner) if field is not None else np.ones(len(lines.owner), bool)
                words = np.bincount(lines.owner, lines.line_words * good, number)
                made = {
                    "n_words": lines.words, "word_chars": lines.word_chars, "n_symbols": lines.symbols, "n_dup_lines": lines.earlier,
                    "n_repeat_words": lines.repeated, "n_lines": np.bincount(lines.owner, minlength=number),
                    "n_content_lines": np.bincount(lines.owner, good, number).astype(np.int64),
                    "content_share": words / np.maximum(lines.words, 1),
                }
                if "content" in outputs:
                    bound = np.searchsorted(lines.owner, np.arange(number + 1)).tolist()
                    made["content"] = [
                        b"\n".join(x for x, ok in zip(lines.texts[a:b], good[a:b].tolist(), strict=True) if ok).decode() for a, b in zip(bound, bound[1:], strict=False)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(made[o], OUTPUTS[o][1]) for o in outputs)], names=[*part.schema.names[:-1], *outputs]
                )

    schema = ", ".join(filter(None, [ddl(rows, tuple(rows.columns[:-1])), *(f"{o} {OUTPUTS[o][0]}" for o in outputs)]))
    return rows.mapInArrow(label, schema)


def keep_quality(docs: DataFrame, field: Field | None, text: str = "text", share: float = KEEP_SHARE) -> DataFrame:
    """docs whose content share is at least `share`; their columns stay as they are."""
    (mark,) = fresh(docs, "content_share")
    outputs = ("content_share",)
    (holder,) = fresh(docs, "row_held")
    held = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias(holder), quoted(text).alias(mark))
    judged = label_lines(held, field, mark, (holder,), outputs).where(F.col("content_share") >= share)
    return judged.select(*(F.col(holder).getField(c).alias(c) for c in docs.columns))
