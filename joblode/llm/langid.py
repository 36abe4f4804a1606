"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as one blank between words; n-grams of two and three characters are
hashed to 2**16 buckets. Tasks count buckets by language, Spark sums the counts, and the matrix of log probabilities
(buckets x languages, at most MAX_LANGUAGES) is broadcast. Texts are scored in numpy by batch.

A text that is null or has no letter is `und` with score 0, and so is every text if there is nothing to learn from.
Ties go to the language that sorts first. Null labels are not learned from. Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from joblode.llm.bpe import by_size
from joblode.llm.common import fresh, quoted

BUCKETS = 1 << 16
MAX_LANGUAGES = 500
SMOOTHING = 0.5
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (text by text), how many each text has, and which texts have letters."""
    joined = " " + "\n".join(t.lower().replace("\n", " ") for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter, cut = _letters()[points], points == 10
    mark = np.where(letter, points, np.uint32(32))
    owner = np.cumsum(cut)
    keep = letter | cut | np.concatenate([[True], letter[:-1] | cut[:-1]])
    mark, owner, cut = mark[keep], owner[keep], cut[keep]
    has = np.bincount(owner[mark != 32], minlength=len(texts)) > 0
    a, b, c = mark[:-2], mark[1:-1], mark[2:]
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two * np.uint32(0x27D4EB2F) + c * np.uint32(0xC2B2AE3D)
    inside = ~cut[1:-1] & ((a != 32) | (b != 32))
    whole = inside & (b != 32)
    hashed = np.stack([_bucket(two), _bucket(three)], 1)
    used = np.stack([inside, whole], 1)
    return hashed[used], np.bincount(owner[1:-1][inside], minlength=len(texts)) + np.bincount(owner[1:-1][whole], minlength=len(texts)), has


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.uint16)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (bucket x language) and log priors of labelled rows."""
    rows = docs.where(docs[lang].isNotNull()).select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in by_size(batch, "__text"):
                hashed, sizes, has = ngrams(texts)
                langs, index = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                got = np.bincount(np.repeat(index, sizes) * BUCKETS + hashed, minlength=len(langs) * BUCKETS).reshape(-1, BUCKETS)
                seen = np.bincount(index[has], minlength=len(langs))
                for name, row, n in zip(langs, got, seen, strict=True):
                    total = totals.setdefault(str(name), np.zeros(BUCKETS + 1, np.int64))
                    total[:-1] += row
                    total[-1] += n
        for name, total in totals.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the broadcast matrix is bounded to {MAX_LANGUAGES}")
    seen = np.zeros((BUCKETS + 1, max(1, len(langs))))
    seen[counts["bucket"], np.searchsorted(langs, counts["lang"]) if langs else []] = counts["n"]
    grams = seen[:-1] + SMOOTHING
    priors = np.log(np.maximum(seen[-1], SMOOTHING))
    return langs, np.log(grams / grams.sum(0)).astype(np.float32), priors - np.log(np.exp(priors).sum())


def identify(docs: DataFrame, learn_from: Column | None = None, text: str = "text", lang: str = "lang", prefix: str = "") -> DataFrame:
    """docs with lang_pred and score (the posterior probability, 0 to 1), names preceded by `prefix`.

    learn_from: which labelled rows to learn from (all if None). Labels are read for learning only. A column of docs
    that has the name of a new one is replaced.
    """
    langs, table, priors = learn(docs if learn_from is None else docs.where(learn_from), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(table.T), priors))
    names = [f"{prefix}lang_pred", f"{prefix}score"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    carried = any(f.name == text and f.dataType == StringType() for f in kept)
    (body,) = (text,) if carried else fresh(docs, "text_read")
    rows = docs.select(*(quoted(f.name) for f in kept), *([] if carried else [quoted(text).cast("string").alias(body)]))
    width = len(kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, priors = shared.value
        for batch in batches:
            for part, texts in by_size(batch, body):
                hashed, sizes, has = ngrams(texts)
                best, score = _best(hashed, sizes, table, priors) if langs else (np.zeros(len(texts), int), np.zeros(len(texts)))
                has = has & bool(langs)
                pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0), pa.float64())],
                    names=[*part.schema.names[:width], *names],
                )

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{names[0]}` string", f"`{names[1]}` double"])
    return rows.mapInArrow(predict, ddl)


def _best(hashed: np.ndarray, sizes: np.ndarray, table: np.ndarray, priors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    logs = np.empty((len(sizes), len(table)))
    for k, row in enumerate(table):
        sums = np.concatenate([[0.0], np.cumsum(row[hashed], dtype=np.float64)])
        logs[:, k] = sums[ends] - sums[ends - sizes] + priors[k]
    best = logs.argmax(1)
    return best, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
