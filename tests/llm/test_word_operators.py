"""Runs, line rules and collocations on small tables with nulls, empty and long texts, ties and repeated rows, against
plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblode.llm import collocations, common, line_rules, periodic, queries

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_text(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(draw.choice([2, 4, 30]))]
    out = []
    for _ in range(draw.randrange(1, 6)):
        out += [draw.choice(vocabulary) for _ in range(draw.randrange(0, 25))]
        out += [draw.choice(vocabulary) for _ in range(draw.randrange(1, 9))] * draw.randrange(1, 9)
    return draw.choice([" ", "\n", " \t "]).join(out)


def sample():
    rows = [(i, made_text(i), ("en", "fr", None)[i % 3], "s") for i in range(60)]
    rows += [(200, None, "en", "s"), (201, "", None, "s"), (202, " \n\x0b ", "en", None), (203, "one", "fr", "s"), (203, "one", "fr", "s")]
    rows += [(None, "a b " * 20, "en", "s"), (None, "a b " * 20, "en", "s"), (204, "no break space " * 9, "en", "s")]
    rows += [(205, " ".join(random.Random(5).choices([f"v{i}" for i in range(3)], k=30_000)), "en", "s"), (206, "same " * 20_000, "de", "s")]
    return rows


EXTRA = ["n_words", "RUNS", "collapsed", "content_share", "text_bytes", "print", "phrase", "a", "quality", "label_id", "row_held", "id", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(i).alias(c) for i, c in enumerate(EXTRA)]
    return common.staged(spark.createDataFrame(sample(), DOCS).repartition(3).select("*", *extra), "sample")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_runs_of_random_words():
    for seed in range(1500):
        draw = random.Random(seed)
        w = [draw.randrange(draw.choice([1, 2, 3, 6])) for _ in range(draw.randrange(0, 60))]
        if draw.random() < 0.7:
            at = draw.randrange(len(w) + 1)
            w[at:at] = [draw.randrange(3) for _ in range(draw.randrange(1, 9))] * draw.randrange(1, 8)
        assert periodic.runs_of(np.array(w, np.int64), np.array([len(w)]))[0] == plain_runs(w), w


def test_texts_of_a_part_do_not_mix():
    texts = [[1, 1, 1], [1, 1, 1, 2, 2], [], [2] * 6 + [1] * 7]
    found = periodic.runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]))
    assert found == [[], [], [], [(0, 6, 1), (6, 7, 1)]]


def test_splitting_keeps_every_run():
    draw = random.Random(3)
    for _ in range(300):
        w = [draw.randrange(4) for _ in range(40)] + [7, 8, 9] * 5 + [draw.randrange(20) for _ in range(30)]
        pieces = list(zip(*periodic.split(np.array(w), np.array([len(w)])), strict=True))
        assert all(min(Counter(w[a:b]).values()) >= 4 for a, b in pieces)
        for start, length, _ in plain_runs(w):
            assert any(a <= start and start + length <= b for a, b in pieces)


def test_find_runs(docs):
    got = periodic.find_runs(docs, keep=("doc_id", "text", "runs", "source")).collect()
    assert len(got) == len(sample())
    for row in got:
        w = WORD.findall(row.text or "")
        runs = [tuple(r) for r in row.runs]
        if len(w) < 5000:
            assert runs == plain_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert row.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone) and row.n_words == len(w)
    assert next(r for r in got if r.doc_id == 206).collapsed == "same"


def test_op11_digests(spark, docs, tmp_path):
    small = docs.where("doc_id is null or doc_id < 205")
    small.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    texts = Counter()
    for row in small.collect():
        w = WORD.findall(row.text or "")
        h = zlib.crc32(str(row.doc_id).encode()) if row.doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        texts[(row.doc_id, len(runs), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))] += 1
    assert Counter(tuple(r) for r in got) == texts
    assert any(row[2] is not None for row in texts)


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def test_counts_of_lines(docs):
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_share", "content")
    got = line_rules.label_lines(docs, None, keep=("text", "doc_id", "content_share"), outputs=outputs).collect()
    assert len(got) == len(sample())
    for row in got:
        assert tuple(row[o] for o in outputs[:6]) == plain_counts(row.text)
        assert row.n_content_lines == row.n_lines and row.content_share == float(row.n_words > 0)
        assert row.content == "\n".join(x for x in (row.text or "").split("\n") if WORD.search(x))


def test_viterbi_against_all_labelings():
    rng = np.random.default_rng(0)
    width = len(line_rules.FEATURES)
    for _ in range(60):
        field = line_rules.Field(rng.normal(size=width), rng.normal(size=(2, 2)))
        owner = np.repeat(np.arange(5), rng.integers(1, 8, 5))
        features = rng.normal(size=(len(owner), width))
        got = line_rules.viterbi(field, features, owner)
        for o in range(5):
            unary = features[owner == o] @ field.weights

            def value(labels):
                return sum(u for u, x in zip(unary, labels, strict=True) if x) + sum(field.steps[a, b] for a, b in itertools.pairwise(labels))

            assert tuple(got[owner == o].astype(int)) == max(itertools.product([0, 1], repeat=len(unary)), key=value)


def test_likelihood_against_all_labelings():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(4, 5, 3)), rng.integers(0, 2, (4, 5))
    used = np.arange(5) < np.array([5, 3, 1, 4])[:, None]
    field = line_rules.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    value, slope = line_rules.likelihood(field, x, y, used)
    total = 0.0
    for w in range(4):
        n = int(used[w].sum())
        score = lambda l, w=w, n=n: sum(x[w, i] @ field.weights * l[i] for i in range(n)) + sum(field.steps[a, b] for a, b in itertools.pairwise(l))  # noqa: E731, E741
        total += score(y[w, :n].tolist()) - np.log(sum(np.exp(score(c)) for c in itertools.product([0, 1], repeat=n)))
    assert abs(value - total / 4) < 1e-9
    for i in range(3):
        moved = field.weights.copy()
        moved[i] += 1e-6
        assert abs((line_rules.likelihood(line_rules.Field(moved, field.steps), x, y, used)[0] - value) / 1e-6 - slope.weights[i]) < 1e-4
    for a, b in itertools.product((0, 1), (0, 1)):
        moved = field.steps.copy()
        moved[a, b] += 1e-6
        assert abs((line_rules.likelihood(line_rules.Field(field.weights, moved), x, y, used)[0] - value) / 1e-6 - slope.steps[a, b]) < 1e-4


def page(seed, bad):
    draw = random.Random(seed)
    sentence = lambda: " ".join(f"{draw.choice('aeiou')}{draw.randrange(300)}word" for _ in range(draw.randrange(6, 20))).capitalize() + "."
    lines = [sentence() for _ in range(draw.randrange(5, 12))]
    return "\n".join(" | ".join(f"{x}$$$" for x in line.split()) for line in lines) if bad else "\n".join(lines)


def test_learned_field_holds_out(spark, tmp_path):
    rows = [(i, page(i, i % 4 == 0), "en", "s") for i in range(240)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("label_id", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    field = line_rules.learn(docs, labels)
    got = line_rules.label_lines(docs, field).where("doc_id >= 120").collect()
    assert all((r.content_share >= line_rules.KEEP_SHARE) == (r.doc_id % 4 != 0) for r in got)
    kept = line_rules.keep_quality(docs, field)
    assert kept.columns == docs.columns and kept.where("doc_id >= 120").count() == 90
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    result = queries.op12_quality_rules(spark, str(tmp_path)).collect()
    assert len(result) == 240 and all(r.kept == (not r.base_failed and r.content_share >= 0.5) for r in result)
    counts = {i: plain_counts(t) for i, t, _, _ in rows}
    assert all(r.base_failed == (counts[r.doc_id][0] < 50 or 100 * counts[r.doc_id][4] > 50 * counts[r.doc_id][0]) for r in result)


def test_nothing_to_learn_from(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert line_rules.learn(docs, none) is None
    assert line_rules.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None
    assert line_rules.label_lines(empty, None).isEmpty() and periodic.find_runs(empty).isEmpty()
    assert collocations.mine(empty).isEmpty()


def plain_phrases(rows, least, longest, top):
    lower = {i: i + 32 for i in range(65, 91)}
    words, count = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * f[p[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                s, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top", "bits"), [(3, 5, 50, 27), (8, 3, 10_000, 10), (2, 2, 7, 12)])
def test_collocations(docs, least, longest, top, bits):
    rows = [(r.text, r.lang) for r in docs.collect()]
    rows = [(t, lang) for t, lang in rows if t is None or len(t) < 50_000]
    small = docs.where("text is null or length(text) < 50000")
    got = collocations.mine(small, least=least, longest=longest, top=top, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id"]
    assert sorted(tuple(r)[:8] for r in got.collect()) == plain_phrases(rows, least, longest, top)


def test_collocations_with_punctuation_and_colliding_prints(spark, monkeypatch):
    draw = random.Random(9)
    marks = ["", "", "", ",", ".", "\n", "\r", "\x0b", "!"]
    rows = [(i, " ".join(draw.choice("AbCde") + draw.choice(marks) for _ in range(200)), "en", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    want = plain_phrases([(t, lang) for _, t, lang, _ in rows], 5, 5, 2000)
    assert sorted(tuple(r)[:8] for r in collocations.mine(docs, least=5).collect()) == want

    class Colliding(collocations.Runs):
        def prints(self, at, width):
            return super().prints(at, width) >> np.uint64(55) << np.uint64(55)

    monkeypatch.setattr(collocations, "Runs", Colliding)
    assert sorted(tuple(r)[:8] for r in collocations.mine(docs, least=5).collect()) == want


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "x", 10**10, 1), ("en", 1, "y", 10**10 + 1, 1), ("en", 2, "x y", 10**10 - 3, 1)], "lang string, width int, phrase string, a long, doc_id long")
    words = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    original = collocations.count_phrases
    collocations.count_phrases = lambda *args: (counts, words)
    try:
        row = collocations.mine(counts).first()
    finally:
        collocations.count_phrases = original
    assert row.score == 1000 * (10**10 - 3) * 10**15 // (10**10 * (10**10 + 1))
