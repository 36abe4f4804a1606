"""Keys found by their form and their words, against a plain version of the graph."""

import random
import re

import pytest

from joblode.llm import pii

DOCS = "doc_id long, text string, lang string, source string"


def key(seed):
    draw = random.Random(seed)
    return "".join(draw.choice("0123456789abcdef") for _ in range(40))


def plain_scores(edges):
    """edges: pattern -> {value: score}; the rounds of the graph by hand."""
    score = {v: s for values in edges.values() for v, s in values.items()}
    while True:
        sure = {}
        for pattern, values in edges.items():
            known = sum(score[v] >= pii.MIN_SCORE for v in values)
            share = sum(score[v] for v in values) / len(values)
            if known >= pii.MIN_SUPPORT and share >= pii.MIN_CONFIDENCE:
                sure[pattern] = share
        after, vote = dict(score), {}
        for v in score:
            miss = 1.0
            for pattern, share in sure.items():
                if v in edges[pattern]:
                    miss *= max(1 - share, 1e-9)
            vote[v] = 1 - miss
            after[v] = max(score[v], vote[v])
        if max(after[v] - score[v] for v in score) <= 1e-9:
            return sure, {v for v in score if vote[v] >= pii.MIN_SCORE}
        score = after


def plain_ids(rows):
    """Texts of one-blank-separated words without base kinds: spans of keys by the plain graph."""
    edges, stands = {}, []
    for doc, text in rows:
        at, words = 0, text.split(" ")
        padded = ["^", "^", *words, "$"]
        for i, word in enumerate(words):
            if re.search("[0-9]", word):
                near = [re.sub("[0-9]+", "0", w.lower()) for w in (padded[i], padded[i + 1], padded[i + 3])]
                for pattern in (f"L {near[0]} {near[1]}", f"M {near[1]} {near[2]}"):
                    if re.search("[a-z]", pattern[2:]):
                        strong = re.fullmatch(r"\W*(?=.*[a-z])(?=.*[0-9])[a-z0-9]{16,}\W*", word.lower()) is not None
                        edges.setdefault(pattern, {})[word.lower()] = 0.9 if strong else 0.0
                        stands.append((pattern, word.lower(), doc, at, at + len(word)))
            at += len(word) + 1
    sure, good = plain_scores(edges)
    return sorted({(doc, a, b) for pattern, value, doc, a, b in stands if pattern in sure and value in good})


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    filler = lambda: [draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(draw.randrange(3, 9))]
    rows = []
    for i in range(12):
        rows.append((i, " ".join([*filler(), "token", "=", f'"{key(i)}"', *filler()])))
    rows.append((20, " ".join([*filler(), "token", "=", "short7", *filler()])))  # found by its words alone
    rows.append((21, " ".join([*filler(), "lone", "hash", key(99), *filler()])))  # a key that no other one bears out
    rows += [(30 + i, " | ".join(str(draw.randrange(10**15, 10**16 - 1) * 10 + 7)[:15] for _ in range(6))) for i in range(4)]
    rows += [(40 + i, f"license version 2.{i} of 201{i}-05-01 alpha") for i in range(6)]
    return rows


def test_keys_equal_the_plain_graph(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS)
    got = []
    for row in pii.find_personal(docs).collect():
        got += [(row.doc_id, *map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("id:")]
    assert sorted(got) == plain_ids(rows)
    assert {doc for doc, *_ in got} == {*range(12), 20}
