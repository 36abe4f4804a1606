"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and odd columns,
against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from joblode.llm import bpe, common, embedding_dedup, exact_dedup, langid, mixing, near_dedup, ngram_lm, pii, sharding, warc

DOCS = "doc_id long, text string, lang string, source string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{int(draw.paretovariate(0.7)) % vocabulary}x" for _ in range(n)]


def text(seed, n):
    return " ".join(words(seed, n))


def sample_docs():
    rows = [(i, text(i, 5 + 7 * i % 60), ("en", "fr", None)[i % 3], f"src{i % 4}") for i in range(40)]
    base = words(99, 80)
    rows += [(100, " ".join(base), "en", "src0"), (101, " ".join(base), "en", "src1"), (102, " ".join(base[:-1]), "fr", None)]
    rows += [(103, " ".join(base[3:]), "en", "src0"), (104, " ".join(base[:40]), "en", "src0")]
    rows += [(105, None, "en", "src1"), (106, "", None, "src1"), (107, " \n\t ", "en", None), (108, "one", "fr", "src2"), (108, "one", "fr", "src2")]
    rows += [(109, "x" * 5000 + " " + text(5, 3000), "en", "src0"), (None, "no id here at all", "en", "src0"), (None, "no id here at all", "en", "src0")]
    rows += [(110, "Ünïcödé\u0001 text \U0001f600 with odd   spaces", "de", "src9"), (111, "ONE", "fr", "src2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(i).alias(c) for i, c in enumerate(["copy_key", "keep_id", "score", "lang_pred", "gone_id", "n_tokens", "name", "key"])]
    return common.staged(spark.createDataFrame(sample_docs(), DOCS).repartition(3).select("*", *extra), "sample")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    outputs = ("n_tokens", "token_ids", "ids_sha256", "decoded", "decoded_sha256")
    got = bpe.tokenize(docs, VOCABULARY, public_tokenizers.PATTERN, keep=("doc_id", "text", "n_tokens"), outputs=outputs).collect()
    assert len(got) == len(sample_docs())
    for row in got:
        body = row.text or ""
        ids = library.encode_ordinary(body)
        assert row.token_ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(row.decoded) == body.encode() and row.decoded_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_bpe_odd_texts_equal_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    letters = "ab thé  \n\t\r'sll12é　 \x85漢字\U0001f600!?-_"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(3000)]
    texts += ["a" * 3000, "abcd" * 700, " " * 2500, "\n" * 2000 + "x", "thetheofand" * 300, "é" * 1500, " a", "a  b", "a   b", "don't I'll"]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    for body, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(body), body[:50]
    assert [d.decode() for d in codec.decode(ids, counts)] == texts


def plain_copies(rows):
    groups = defaultdict(list)
    for i, body, *_ in rows:
        groups[body or ""].append(i)
    keep = {b: max((i for i in ids if i is not None), default=None) for b, ids in groups.items()}
    return [(i, keep[b or ""], len(groups[b or ""]), i == keep[b or ""], hashlib.sha256((b or "").encode()).hexdigest()) for i, b, *_ in rows]


def test_exact_copies(docs):
    got = [tuple(r) for r in exact_dedup.find_copies(docs).collect()]
    assert Counter(got) == Counter(plain_copies(sample_docs()))


def test_exact_copies_dropped(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text or "") for r in kept.collect())
    assert got == Counter({(k, b or "") for (i, b, *_), (_, k, *_) in zip(sample_docs(), plain_copies(sample_docs()), strict=True)})


def test_a_crowded_filter_loses_nothing(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BITS", 64)
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 64)
    assert Counter(tuple(r) for r in exact_dedup.find_copies(docs).collect()) == Counter(plain_copies(sample_docs()))


def test_only_possible_copies_shuffle(docs):
    plan = exact_dedup.drop_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan and "Python" not in plan


def bag(body):
    w = (body or "").lower().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else zip(*[w[i:] for i in range(5)], strict=False))


def similarity(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def plain_classes(rows):
    nodes = sorted({i for i, *_ in rows if i is not None})
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, bag(b)) for i, b, *_ in rows if i is not None]
    for x, (i, a) in enumerate(known):
        for j, b in known[:x]:
            if similarity(a, b) >= 0.8:
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i in nodes}


def test_near_classes(docs):
    want = plain_classes(sample_docs())
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(sample_docs())
    assert all(r.class_id == want.get(r.doc_id) and r.kept == (r.class_id == r.doc_id) for r in got)
    assert want[101] == want[102] == want[103] == 100 and want[104] == 104
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *want.values()}


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = text(1, 60), text(2, 60), text(3, 60)
    rows = [(5, a), (5, b), (3, b), (7, c), (7, a), (9, f"{c} end"), (2, text(4, 60)), (2, text(4, 60)), (8, text(5, 60))]
    got = near_dedup.near_classes(spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((i, {2: 2, 8: 8}.get(i, 3)) for i, _ in rows)
    kept = near_dedup.drop_near(spark.createDataFrame([(i, t, "en", "s") for i, t in rows], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 3, 8]


def test_repeated_ids_with_other_vectors(spark, monkeypatch):
    """Every vector is near exactly two others; ids repeat over vectors that are far from each other."""
    from joblode.llm import buckets

    monkeypatch.setattr(buckets, "BLOCK", 2)
    draw = np.random.default_rng(9)
    base = draw.standard_normal((12, 16))
    rows = [(j % 5 + 10 * k, (v + 0.02 * draw.standard_normal(16)).tolist()) for j, v in enumerate(base) for k in range(3)]
    rows += [rows[0], (1, None)]
    unit = [np.array(v) / np.linalg.norm(v) if v else None for _, v in rows]
    near = [[j for j, y in enumerate(unit) if j != i and x is not None and y is not None and x @ y >= 0.95] for i, x in enumerate(unit)]

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        return min(rows[j][0] for j in seen)

    got = embedding_dedup.find_near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = Counter((i, len(near[n]), reach(n), i == reach(n)) for n, (i, _) in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_a_chain_of_edits_is_one_class_in_many_blocks(spark, monkeypatch):
    """Neighbours are alike, the ends are not; buckets are cut into small blocks."""
    from joblode.llm import buckets

    monkeypatch.setattr(buckets, "BLOCK", 4)
    monkeypatch.setattr(buckets, "SHARD_ROWS", 16)
    rows, line = [], words(7, 120)
    for i in range(40):
        rows.append((i, " ".join(line), "en", "s"))
        line = [*line[3:], *words(1000 + i, 3)]
    rows += [(100 + i, text(500 + i, 60), "en", "s") for i in range(20)]
    want = plain_classes(rows)
    got = near_dedup.near_classes(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(set(want.values())) < 25


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(5)
    element = draw.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = draw.integers(1, 40, 300), draw.integers(1, 40, 300)
    owner = np.repeat([0, 1], 300)
    registers = 4096
    found = near_dedup.signatures(2, owner, np.concatenate([element, element]), np.concatenate([a, b]), registers)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - true) < 5 * math.sqrt(true * (1 - true) / registers)


def sample_vectors():
    draw = np.random.default_rng(4)
    base = draw.standard_normal((30, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (v + 0.08 * draw.standard_normal(16)).tolist()) for i, v in enumerate(base[:12])]
    rows += [(200 + i, (base[0] + 0.03 * draw.standard_normal(16)).tolist()) for i in range(40)]
    rows += [(300, base[1].tolist()), (301, (3 * base[1]).tolist()), (302, None), (303, []), (304, [0.0] * 16), (305, [math.nan] * 16)]
    rows += [(306, [math.inf, *[0.0] * 15]), (307, [None, *[1.0] * 15]), (308, [1.0, 2.0]), (309, [1.0, 2.0]), (None, base[2].tolist()), (310, [1e-200] * 16), (311, [1.0] * 16)]
    return rows


def test_embedding_links(spark, monkeypatch):
    from joblode.llm import buckets

    monkeypatch.setattr(buckets, "BLOCK", 8)
    rows = sample_vectors()
    unit = {}
    for i, v in rows:
        ok = i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        unit[i] = x / np.linalg.norm(x) if ok else None
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95
    want = {i: [j for j in unit if j != i and near(unit[i], unit[j])] for i in unit}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            new = set(want[todo.pop()]) - seen
            seen |= new
            todo += new
        return min(x for x in seen if x is not None) if i is not None else None

    got = embedding_dedup.find_near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == (len(want[r.vec_id]), reach(r.vec_id)), r
        assert r.kept == (r.vec_id == r.component_id)


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.5, 0.0])
def test_any_number_of_vectors_has_a_plan(threshold):
    near = embedding_dedup.collision(math.sqrt(2 - 2 * threshold))
    for rows in (0, 10**3, 2 * 10**8, 10**9, 10**12):
        k, tables = embedding_dedup.plan(rows, threshold)
        assert k >= 1 and tables <= embedding_dedup.MAX_TABLES and (1 - near**k) ** tables <= embedding_dedup.MISS


def test_components(spark):
    draw = random.Random(2)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 360)] + [(draw.randrange(400, 600), draw.randrange(400, 600)) for _ in range(120)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}


def plain_bayes(rows, learn):
    """Naive Bayes with dictionaries, over n-grams of two and three characters as the module states them."""

    def grams(body):
        marks = " " + re.sub(r"[^\W\d_]+|.", lambda m: m.group() if m.group()[0].isalpha() else " ", (body or "").lower(), flags=re.S) + " "
        marks = re.sub(" +", " ", marks)
        two = [marks[i : i + 2] for i in range(len(marks) - 1)]
        return two + [marks[i : i + 3] for i in range(len(marks) - 2) if marks[i + 1] != " "]

    known = sorted({k for i, _, k, _ in rows if k is not None and learn(i)})
    seen = {k: Counter(g for i, b, lg, _ in rows if lg == k and learn(i) for g in grams(b)) for k in known}
    texts = Counter(k for i, b, k, _ in rows if k is not None and learn(i) and any(c.isalpha() for c in b or ""))
    for i, b, *_ in rows:
        if not any(c.isalpha() for c in b or ""):
            yield i, "und", 0.0
            continue
        logs = {k: math.log(texts[k] / sum(texts.values())) + sum(math.log((seen[k][g] + 0.5) / (sum(seen[k].values()) + 0.5 * langid.BUCKETS)) for g in grams(b)) for k in known}
        best = max(known, key=lambda k: logs[k])
        yield i, best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


def test_languages(spark, docs):
    draw = random.Random(1)
    sounds = {"aa": "ka lo mi tu", "bb": "zr xq vw gh", "cc": "éü öä ñç"}
    rows = [(i, " ".join("".join(draw.choices(sounds[k].split(), k=3)) for _ in range(30)), k, "s") for i in range(240) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(900, None, "aa", "s"), (901, "12 %% 3", "bb", "s"), (902, "kalomi", None, "s"), (902, "kalomi", None, "s"), (None, "xqvw", None, None)]
    out = langid.identify(spark.createDataFrame(rows, DOCS), learn_from=common.doc_remainder("doc_id", 3) != 1).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 900:
            assert r.lang_pred == r.lang
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[900] == by[901] == ("und", 0.0) and by[902][0] == "aa" and by[None][0] == "bb"
    plain = plain_bayes(rows, lambda i: i is None or zlib.crc32(str(i).encode()) % 3 != 1)
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in out) == Counter((i, k, round(p, 4)) for i, k, p in plain)
    replaced = langid.identify(docs)
    assert replaced.columns.count("score") == replaced.columns.count("lang_pred") == 1 and replaced.count() == len(sample_docs())


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    return sum(v if not i % 2 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(body):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, body or "") if ok(m.group())]


def test_personal_data(spark):
    draw = random.Random(8)
    bits = ["a.b@c.de", "x@y", "@", "a@b@c.d_e@f.g", "4111 1111-1111 1111", "4111111111111112", "+49 (30) 1234-567", "+1 2", "++12345678", "255.255.0.1",
            "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.4", "é", "\U0001f600", "\u0001", "0" * 25, " ", "- ", "+", "7", "..", "_%", "a-b.c", "\n", "word", "5500-0000 0000-0004"]
    bodies = ["".join(draw.choices(bits, k=draw.randrange(1, 14))) for _ in range(1500)]
    bodies += [None, "", "9" * 3000, "1-" * 2500, "a@" + "b." * 9000 + "c", "a" * 3000, "1." * 2500, "+" + "1 " * 2500, "bits " * 4000 + "q@w.er"]
    rows = [(i, b, None, None) for i, b in enumerate(bodies)] + [(0, bodies[0], None, None), (None, "me@x.org", None, None)]
    got = pii.find_personal(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = defaultdict(set)
    for i, b, *_ in rows:
        want[i].add(",".join(base_spans(b)))
    for r in got:
        (spans,) = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), r.doc_id
        assert r.spans.startswith(spans) and r.n_id == r.spans.count("id:")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans.split(",")) for k, *_ in RULES]


def test_patterns_of_known_identifiers_find_new_ones(spark):
    rows = [(i, f"{text(i, 9)} please write to user{i}@mail.org or wait", None, None) for i in range(12)]
    rows += [(50, "so please write to account-77123 or wait there", None, None), (51, "the year 1997 was fine", None, None), (52, "item 12345 of 99999", None, None)]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(rows, DOCS)).collect()}
    at = rows[12][1].index("account-77123")
    assert got[50] == f"id:{at}:{at + len('account-77123')}" and got[51] == got[52] == ""
    assert all(got[i].startswith("email:") and "id:" not in got[i] for i in range(12))


def test_identifiers_of_any_length_are_found(spark):
    rows = [(i, f"{text(i, 9)} please write to user{i}@mail.org or wait", None, None) for i in range(20)]
    names = {50: "a1b", 51: "7", 52: "k" * 64 + "9", 53: "5" + "k" * 499, 54: "abcd-5678"}
    rows += [(i, f"so please write to {name} or wait there", None, None) for i, name in names.items()]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: got[i] for i in names} == {i: f"id:19:{19 + len(name)}" for i, name in names.items()}


def test_patterns_are_followed_to_the_end_of_a_chain(spark):
    steps = 7
    rows = [(i, f"start with s{i}@mail.org end", None, None) for i in range(6)]
    # beside five seeds, step k holds the identifiers of step k - 1 and k: without the first, its confidence is 5/7
    chain = [(k, f"code{k}-{k}x") for k in range(steps)]
    seeds = [f"s{i}@mail.org" for i in range(6)]
    for k, name in chain:
        held = [*seeds[:5], chain[k - 1][1] if k else seeds[5], name]
        rows += [(100 * (k + 1) + j, f"step {'abcdefghij'[k]}word {x} {'abcdefghij'[k]}{j}end", None, None) for j, x in enumerate(held)]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(f"id:11:{11 + len(name)}" == got[100 * (k + 1) + 6] for k, name in chain)


def test_contexts_are_whole_words_behind_any_blanks(spark):
    gap = " \n" * 60
    rows = [(i, f"{text(i, 9)} please write{gap}user{i}@mail.org{gap}or wait", None, None) for i in range(12)]
    rows += [(50 + i, f"{text(i, 9)} other words{gap}item-{i}{gap}more", None, None) for i in range(12)]
    rows += [(90, f"please write{gap}account-77123{gap}or", None, None), (91, "1997 was fine", None, None)]
    got = {r.doc_id: r.spans for r in pii.find_personal(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[90] == "id:132:145" and {got[i] for i in (*range(50, 62), 91)} == {""}
    assert all(got[i].startswith("email:") and "id:" not in got[i] for i in range(12))


def test_shards(spark, docs):
    hot = [(1000 + i, "hot text " * 9, "en", "s") for i in range(300)] + [(None, "hot text " * 9, "en", "s")] * 40
    rows = [*((i, text(i, 20 + i % 30), "en", "s") for i in range(600)), *sample_docs()[:-6], *hot]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), 8, bundles=256).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(by) == set(range(8))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    size = [sum(r["size"] for r in v) for v in by.values()]
    tokens = [sum(r.tokens for r in v) for v in by.values()]
    assert max(size) - min(size) <= 0.01 * sum(size) / 8 and max(tokens) < 1.15 * min(tokens) and max(map(len, by.values())) < 1.15 * min(map(len, by.values()))
    want = Counter((i, len((b or "").encode()) + 16, zlib.crc32((b or "").encode())) for i, b, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    home = defaultdict(set)
    for r in got:
        home[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in home.values()) == 1  # the hot group is the only one dealt into pieces


def plain_pack(items, shards):
    total = [sum(x) for x in zip(*items, strict=True)]
    scaled = [[x / t for x, t in zip(item, total, strict=True)] for item in items]
    left, where = [[1 / shards] * len(total) for _ in range(shards)], {}
    for i in sorted(range(len(items)), key=lambda i: -max(scaled[i])):
        fit = [sum(x * y for x, y in zip(room, scaled[i], strict=True)) for room in left]
        where[i] = max(range(shards), key=lambda k: (round(fit[k], 15), -k))
        left[where[i]] = [x - y for x, y in zip(left[where[i]], scaled[i], strict=True)]
    return [where[i] for i in range(len(items))]


@pytest.mark.parametrize("seed", range(4))
def test_packing_and_exchange(seed):
    draw = np.random.default_rng(seed)
    items = np.stack([draw.lognormal(6, 1, 300), draw.lognormal(3, 1, 300), draw.integers(1, 4, 300)], 1)
    first = sharding.pack(items, 7)
    assert first.tolist() == plain_pack(items.tolist(), 7)
    then = sharding.exchange(items, first, 7)
    load = lambda w: np.stack([np.bincount(w, items[:, m], 7) for m in range(3)])
    assert np.ptp(load(then)[0]) <= 0.01 * items[:, 0].sum() / 7
    assert all(np.ptp(load(then)[m]) <= 0.2 * items[:, m].sum() / 7 for m in (1, 2))
    one = np.array([[5.0, 1, 1]] * 3)
    assert np.bincount(sharding.exchange(one, np.zeros(3, int), 2)).tolist() in ([1, 2], [2, 1])  # as near as three equal items get
    assert sharding.exchange(np.zeros((3, 3)), np.zeros(3, int), 2).tolist() == [0, 0, 0]


def test_a_group_within_a_share_stays_whole(spark):
    rows = [(i, f"{i} " + text(i, 20), "en", "s") for i in range(200)] + [(1000 + i, "copies of one text", "en", "s") for i in range(40)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), 4).collect()  # 40 of 240 rows, four shards: between half a share and a share
    assert len({r.shard for r in got if r.doc_id >= 1000}) == 1


def test_pages_survive_the_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 25)
    big = "<p>\r\n\r\nWARC/1.1 é</p>" * 60
    rows = [(i, f"http://h{i % 5}.example.org/p{i % 7}?q={i}", f"<html>{text(i, 30 + i)}</html>") for i in range(90)]
    rows += [(200, "http://a.org/x y\r\n", big), (201, "http://b.org/", big), (202, None, big), (203, "http://a.org/", None), (204, "http://[bad", "")]
    rows += [(205, "http://s.org/", "small"), (206, "http://s.org/", "small"), (None, "http://n.org/", big), (201, "http://b.org/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.round_trip(pages, F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0)), archive_bytes=9000).collect()
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = h in last and last[h] != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)

    order = lambda r: (r.url_key, r.captured, r.page_id is not None, r.page_id or 0)
    assert sorted(r.position for r in got) == list(range(1, len(rows) + 1))
    assert [order(r) for r in sorted(got, key=lambda r: r.position)] == sorted(map(order, got))

    folder = common.scratch(spark, "warc")
    index = warc.numbered(warc.capture_histories(warc.write_archives(pages, folder, F.lit(7))))
    for wrong in ({"length": F.col("length") - 1}, {"page_id": F.col("page_id") + 1}, {"offset": F.col("offset") + 1}):
        with pytest.raises(Exception, match="index|record"):
            warc.read_records(folder, index.withColumns(wrong)).collect()
    some = warc.read_records(folder, index.where("position % 7 = 3")).collect()
    assert sorted(r.position for r in some) == [n for n in range(1, len(rows) + 1) if n % 7 == 3]

    runs = warc.write_archives(pages, common.scratch(spark, "warc"), F.lit(5) * F.col("page_id"), archive_bytes=9000)
    merged = [(r.url_key, r.captured, r.page_id) for r in warc.capture_histories(runs).collect()]
    key = lambda x: (x[0], x[1], x[2] is not None, x[2] or 0)
    assert merged == sorted(merged, key=key) and len(merged) == len(rows) and runs.select("file").distinct().count() > 4


@pytest.mark.parametrize("sizes", [[], [0], [5], [3, 0, 4], [1, 2, 3, 4, 5], [7] * 8, [2, 9, 0, 0, 1, 6]])
def test_loser_tree(sizes):
    draw = random.Random(sum(sizes))
    runs = [sorted((draw.randrange(20), f"{i}-{j}") for j in range(n)) for i, n in enumerate(sizes)]
    out = list(warc.merge(runs))
    assert [k for k, _ in out] == sorted(k for run in runs for k, _ in run) and sorted(out) == sorted(x for run in runs for x in run)


def test_language_model(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "RANGE_TOKENS", 300)
    rows = sample_docs() + [(500 + i, text(i % 15, 60), "en", "s") for i in range(60)]
    got = ngram_lm.score(spark.createDataFrame(rows, DOCS).repartition(5), common.doc_remainder("doc_id", 5) == 1, block_tokens=500).collect()
    tokens = lambda b: [*re.findall(rb"[^\x20\x09-\x0D]+", (b or "").encode().lower()), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen = Counter(t for i, b, *_ in rows if not held(i) for t in tokens(b))
    n, v = sum(seen.values()), len(seen)
    want = sorted(
        (str(i), held(i), len(tokens(b)), sum(seen[t] > 0 for t in tokens(b)), n, round(sum(math.log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(b)), 6))
        for i, b, *_ in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    plain = plain_interpolation([(i, tokens(b), held(i)) for i, b, *_ in rows])
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), round(x, 6)) for i, x in plain)
    out = [r for r in got if r.held_out and r.doc_id >= 500]  # texts that training texts repeat
    assert out and all(r.score < 0 for r in got) and sum(r.score for r in out) > sum(r.base_score for r in out)


def plain_interpolation(rows):
    """rows: (id, tokens, held out). Scores with dictionaries; ratios of the deleted tokens to quarter doublings, as stated."""
    deleted = {i for i, _, out in rows if not out and ngram_lm.deleted([i])[0]}
    assert 3 < len(deleted) < len(rows) / 2
    pairs = lambda ts: zip(["start", *ts], ts)

    def counts(chosen):
        one = Counter(t for ts in chosen for t in ts)
        return one, Counter(p for ts in chosen for p in pairs(ts)), {**one, "start": len(chosen)}, sum(one.values())

    whole = counts([ts for _, ts, out in rows if not out])
    one, two, context, n = counts([ts for i, ts, out in rows if not out and i not in deleted])
    v = len(whole[0]) + 1
    near = lambda x: 2 ** (round(4 * math.log2(x)) / 4) if x else 0.0
    seen = defaultdict(Counter)
    for i, ts, out in rows:
        for a, b in pairs(ts) if i in deleted and not out else ():
            c = context.get(a, 0)
            seen[c.bit_length()][near(two[a, b] / max(c, 1) * v), near(one[b] / n * v)] += 1
    weights = {}
    for k in range(ngram_lm.BUCKETS):
        w = [1 / 3] * 3 if k else [0, 0.5, 0.5]
        for _ in range(ngram_lm.EM_ROUNDS if seen[k] else 0):
            part = [0.0] * 3
            for (x, y), m in seen[k].items():
                terms = [w[0] * x, w[1] * y, w[2]]
                part = [p + m * t / sum(terms) for p, t in zip(part, terms)]
            w = [p / sum(part) for p in part]
        w = [max(w[0], 1e-9 * (w[0] > 0)), max(w[1], 1e-9 * (w[1] > 0)), max(w[2], 1e-9)]
        weights[k] = [x / sum(w) for x in w]
    for i, ts, _ in rows:
        total = 0.0
        for a, b in pairs(ts):
            c = whole[2].get(a, 0)
            w = weights[c.bit_length()]
            total += math.log10(w[0] * whole[1][a, b] / max(c, 1) + w[1] * whole[0][b] / whole[3] + w[2] / v)
        yield i, total


def test_large_ids_beside_a_null_id(spark):
    rows = [(2**62 + 1, "a b"), (None, "a c"), (-(2**62) - 1, "a b")]
    got = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.lit(False)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}


def test_weights_fit_what_held_out_counts_say():
    """Where the pair estimate is right and the others are not, it gets the weight; where it is nil, none."""
    cell = lambda b, pair, single: b << 16 | pair << 8 | single
    weights = ngram_lm.learn_weights(np.array([cell(5, 168, 128), cell(7, 0, 148)]), np.array([1000.0, 1000.0]))
    assert weights[5, 0] > 0.99 and weights[7, 0] < 1e-6 and weights[7, 1] > 0.99
    assert np.allclose(weights.sum(1), 1)


def plain_budget(children, budget):
    """children: name -> (capacity, weight). Fill in rounds what is short."""
    out, open_ = dict.fromkeys(children, 0.0), {k for k, (c, w) in children.items() if c > 0 and w > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][1] for k in open_)
        short = [k for k in open_ if children[k][0] - out[k] <= budget * children[k][1] / total + 1e-9]
        if not short:
            for k in open_:
                out[k] += budget * children[k][1] / total
            break
        for k in short:
            budget -= children[k][0] - out[k]
            out[k] = children[k][0]
            open_.discard(k)
    return out


def row_name(i, body):
    return str(i) if i is not None else "null-" + hashlib.md5((body or "").encode()).hexdigest()


def plain_mix(rows, weights, share, epochs, seed):
    """rows: (id, text, lang, source, domain). Counts of (name, leaf, target, copies)."""
    weight = {(d, lg, s)[:lv]: w or 0.0 for lv, d, lg, s, w in weights}
    of = lambda p: weight.get(p, 1.0)
    tokens = {row_name(i, b): len(re.findall(r"[^ \t\n\x0b\f\r]+", b or "")) for i, b, *_ in rows}
    leaves, supply = defaultdict(list), Counter()
    for i, b, lg, s, d in rows:
        leaves[(d, lg, s)].append(row_name(i, b))
        supply[(d, lg, s)] += tokens[row_name(i, b)]
    cap = {p: supply[p] * epochs if all(of(p[:k]) > 0 for k in (1, 2, 3)) else 0 for p in leaves}
    level = {(): min(math.floor(sum(supply.values()) * share), sum(cap.values()))}
    for k in (1, 2, 3):
        below = {}
        for up, budget in level.items():
            kids = {p[:k] for p in cap if p[: k - 1] == up}
            below |= plain_budget({p: (sum(c for q, c in cap.items() if q[:k] == p), of(p)) for p in kids}, budget)
        level = below
    want = Counter()
    for p, names in leaves.items():
        target = math.floor(level[p] + 1e-6)
        whole = target // supply[p] if supply[p] else 0
        rest, used = target - whole * supply[p], 0
        key = lambda n, whole=whole: hashlib.md5(f"{seed}-{whole + 1}-{n}".encode()).hexdigest()
        for name in sorted(set(names), key=key):
            used += tokens[name] * names.count(name)
            want[(name, p, target, whole + (used <= rest) if tokens[name] else 0)] += names.count(name)
    return want


def test_mix(spark):
    draw = random.Random(6)
    rows = [(i, text(i, draw.randrange(1, 50)), draw.choice(["en", "fr", None]), draw.choice(["a1", "a2", "b1", None])) for i in range(300)]
    rows += [(400, None, "en", "a1"), (401, " ", "en", "a1"), (None, "one two three", "fr", "b1"), (None, "one two three", "fr", "b1"), (7, rows[7][1], rows[7][2], rows[7][3])]
    weights = [(1, "a", None, None, 3.0), (2, "a", "fr", None, 0.0), (2, "b", "en", None, 5.0), (3, "a", "en", "a2", 4.0), (3, "b", "fr", "b1", None)]
    table = spark.createDataFrame(weights, mixing.WEIGHTS)
    got = mixing.select_mix(spark.createDataFrame(rows, DOCS), table, 0.7, 2, 3, domain=F.left("source", F.lit(1))).collect()
    want = plain_mix([(*r, r[3][0] if r[3] else None) for r in rows], weights, 0.7, 2, 3)
    assert Counter((row_name(r.doc_id, "one two three"), (r.domain, r.lang, r.source), r.target, r.copies) for r in got) == want
    assert len({r.copies for r in got}) == 3


def test_mix_with_fine_slices(spark, monkeypatch):
    """More rounds of slices give the same choice."""
    rows = spark.createDataFrame([(i, text(i, 3 + i % 9), "en", f"s{i % 2}") for i in range(400)], DOCS)
    weights = spark.createDataFrame([], mixing.WEIGHTS)
    run = lambda: {r.doc_id: r.copies for r in mixing.select_mix(rows, weights, 0.37, 1, 5, domain=F.lit("d")).collect()}
    one = run()
    monkeypatch.setattr(mixing, "SLICE_ROWS", 1)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert run() == one and 0 < sum(one.values()) < 400


def test_empty_tables(spark, empty):
    weights = spark.createDataFrame([], mixing.WEIGHTS)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for frame in (
        bpe.tokenize(empty, VOCABULARY, public_tokenizers.PATTERN), exact_dedup.find_copies(empty), exact_dedup.drop_copies(empty),
        near_dedup.near_classes(empty), near_dedup.drop_near(empty), embedding_dedup.find_near(vectors), langid.identify(empty),
        pii.find_personal(empty), sharding.shard(empty), ngram_lm.score(empty, F.lit(False)), warc.round_trip(pages, F.col("page_id")),
        mixing.select_mix(empty, weights, 0.5, 2, 1, domain=F.col("source")), mixing.keep_mix(empty, weights, 0.5, 1, F.col("source")),
    ):
        assert frame.collect() == []


def test_all_rows_null(spark):
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, DOCS)
    weights = spark.createDataFrame([], mixing.WEIGHTS)
    assert {r.n_tokens for r in bpe.tokenize(nulls, VOCABULARY, public_tokenizers.PATTERN).collect()} == {0}
    assert [(r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(nulls).collect()] == [(None, 3, True)] * 3
    assert exact_dedup.drop_copies(nulls).count() == 1
    assert [(r.class_id, r.kept) for r in near_dedup.near_classes(nulls).collect()] == [(None, True)] * 3
    assert {r.lang_pred for r in langid.identify(nulls).collect()} == {"und"}
    assert {r.spans for r in pii.find_personal(nulls).collect()} == {""}
    assert sorted(r.slot for r in sharding.shard(nulls, 1).collect()) == [0, 1, 2]
    assert {r.n_tokens for r in ngram_lm.score(nulls, F.lit(None).cast("boolean")).collect()} == {1}
    assert {r.copies for r in mixing.select_mix(nulls, weights, 0.5, 2, 1, domain=F.col("source")).collect()} == {0}
