"""Personal data: rules for e-mail, IP, card and phone, and a bootstrapped search for identifiers that no rule knows.

Rules find the base spans. They are the first seeds; tokens with the form of a key are the second (KEY: at least sixteen
characters of letters and digits mixed, less quotes and the like around them), at a score of KEY_SCORE. The words around
a seed are a lexical pattern (the two words before it, or the words on both sides; words are cut at white space, however
far off); words without any letter, as in the cells of a table, are none. Other tokens with digits, of any length, are
candidates. Patterns and the identifiers that stand in them form a graph, which Spark scores in rounds: a pattern's
confidence is the known share of its different identifiers, an identifier's is the chance that one of its reliable
patterns is right. So a key alone is no finding: others of its kind must stand in the same words. A pattern is reliable if MIN_SUPPORT different
known identifiers stand in it and its confidence reaches MIN_CONFIDENCE. Rounds end when no pattern can become reliable
any more, or when no score rises by more than SETTLED. Identifiers that reach MIN_SCORE then become spans of kind `id` wherever they stand in a reliable pattern.

Only DataFrame operations run. A match is marked in the text and the text cut at the marks, so offsets are sums of
lengths (code points, end exclusive). The patterns are possessive and bound to the start of a run, so each text is
read in linear time; what they find is what the plain forms find.

Null text counts as empty. Rows that repeat an id and a text get the same result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm.common import attach, quoted, staged

MARK, MARK_ALIAS, HIDE = "\u0001", "\u0002", "\u0003"
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind -> (guard, pattern)
RULES = {
    "email": ("@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
KEY = r"^[^\p{L}\p{N}]*+(?=[A-Za-z0-9_-]*[A-Za-z])(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{16,}+[^\p{L}\p{N}]*+$"
KEY_SCORE = 0.9
LONG = 64
REACHES = [80, 80 << 4, 80 << 8, 80 << 12]
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.8
SETTLED = 1e-9


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _guarded(text: Column, guard: str) -> Column:
    return F.contains(text, F.lit(guard)) if guard == "@" else text.rlike(guard)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at its matches; every second piece is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _spans(text: Column, kind: str, pattern: str, guard: Column, valid) -> Column:
    """array<struct(kind, start, end, value)> of the valid matches, in order."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), piece.alias("value"))
        found = F.when(acc["odd"] & valid(piece), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), found.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), empty.alias("spans"))
    return F.when(guard, F.aggregate(_pieces(text, pattern), begin, step, lambda acc: acc["spans"])).otherwise(empty)


def _hidden(text: Column, kind: str) -> Column:
    """The text with the valid matches of a rule written over, as long as before."""
    guard, pattern = RULES[kind]
    cover = F.transform(
        _pieces(text, pattern), lambda piece, i: F.when((i % 2 == 1) & _valid(kind, piece), F.rpad(F.lit(""), F.length(piece), HIDE)).otherwise(piece)
    )
    return F.when(_guarded(text, guard), F.array_join(cover, "")).otherwise(text)


def scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, base and more: arrays of spans with the words around them."""
    body = F.translate(F.coalesce(quoted(text).cast("string"), F.lit("")), MARK, MARK_ALIAS)
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.md5(F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary")).alias("text_key"), body.alias("body"))
    rows = rows.withColumn("digits", F.col("body").rlike("[0-9]") | F.contains("body", F.lit("@")))
    plain = rows.where("not digits").select("doc_id", "text_key", F.array().cast(_WITH_CONTEXT).alias("base"), F.array().cast(_WITH_CONTEXT).alias("more"))
    rich = rows.where("digits")
    for kind, (guard, pattern) in RULES.items():
        rich = rich.withColumn(kind, _spans(F.col("body"), kind, pattern, _guarded(F.col("body"), guard), lambda x, kind=kind: _valid(kind, x)))
    rich = rich.withColumn("rest", F.col("body"))
    for kind in ("phone", "card", "email", "ip"):
        rich = rich.withColumn("rest", _hidden(F.col("rest"), kind))
    rich = rich.withColumn("more", _spans(F.col("rest"), "id", CANDIDATE, F.col("rest").rlike("[0-9]"), lambda x: ~F.contains(x, F.lit(HIDE))))
    return plain.unionByName(
        rich.select("doc_id", "text_key", _with_context(F.concat(*RULES)).alias("base"), _with_context(F.col("more")).alias("more"))
    )


_WITH_CONTEXT = "array<struct<kind:string,start:int,end:int,value:string,key:boolean,patterns:array<string>>>"


def _with_context(spans: Column) -> Column:
    def words(span: Column) -> Column:
        before = F.split(_trimmed(F.concat(F.lit("^ ^ "), _plain(_left(span["start"])))), r"\s+")
        after = F.split(_trimmed(F.concat(_plain(_right(span["end"])), F.lit(" $"))), r"\s+", 2)
        near = F.transform(F.concat(F.slice(before, -2, 2), F.slice(after, 1, 1)), _short)
        return F.struct(*(span[c].alias(c) for c in ("kind", "start", "end", "value")), near.alias("near"))

    def add(span: Column) -> Column:
        word = [span["near"][i] for i in range(3)]
        patterns = F.array(F.concat_ws(" ", F.lit("L"), word[0], word[1]), F.concat_ws(" ", F.lit("M"), word[1], word[2]))
        patterns = F.filter(patterns, lambda p: p.rlike(r"^. .*\p{L}"))
        return F.struct(
            span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), _short(F.lower(span["value"])).alias("value"),
            span["value"].rlike(KEY).alias("key"), patterns.alias("patterns"),
        )

    return F.transform(F.transform(spans, words), add)


def _left(start: Column) -> Column:
    """What stands before a span, back to two whole words at least. Most are near, so the rest is not read for them."""
    out = F.substring(F.col("body"), F.lit(1), start)
    for reach in reversed(REACHES):
        part = F.substring(F.col("body"), F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
        out = F.when((start <= reach) | part.rlike(r"\s\S++\s++\S++\s*+$"), part).otherwise(out)
    return out


def _right(end: Column) -> Column:
    """What stands behind a span, on to a whole word at least."""
    out = F.substring(F.col("body"), end + 1, F.length("body"))
    for reach in reversed(REACHES):
        part = F.substring(F.col("body"), end + 1, F.lit(reach))
        out = F.when((F.length(part) < reach) | part.rlike(r"^\s*+\S++\s"), part).otherwise(out)
    return out


def _trimmed(words: Column) -> Column:
    return F.btrim(words, F.lit(" \t\n\u000b\f\r"))


def _short(word: Column) -> Column:
    """A word of more than LONG characters by its digest, which is longer than any word that stays as it is."""
    return F.when(F.length(word) <= LONG, word).otherwise(F.concat(F.lit("#"), F.sha2(word.cast("binary"), 256)))


def _plain(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[0-9]+", "0")


def discovered(found: DataFrame) -> DataFrame:
    """Spans beyond the rules: doc_id, text_key, start, end. found: from scanned()."""
    spans = found.select("doc_id", "text_key", F.explode(F.concat("base", "more")).alias("s"))
    stands = staged(
        spans.select("doc_id", "text_key", "s.kind", "s.start", "s.end", "s.value", "s.key", F.explode("s.patterns").alias("pattern")), "pii-stands"
    )
    known = F.when(F.col("kind") != "id", 1.0).when(F.col("key"), KEY_SCORE).otherwise(0.0)
    graph = stands.groupBy("pattern", "value").agg(F.max(known).alias("seed"))
    # only patterns of enough identifiers can ever be reliable, and only their identifiers matter
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("patterns_size")).where(F.col("patterns_size") >= MIN_SUPPORT)
    edges = staged(attach(graph, staged(sizes, "pii-patterns"), "pattern", "patterns_size", graph.count()).select("pattern", "value", F.col("seed").alias("score")), "pii-edges")
    total = edges.count()
    before, rise = None, 1.0
    while True:
        # scores only rise, to 1 at most: a pattern whose identifiers above 0 are too few will not be reliable in a later
        # round either, and without one that may still be, the reliable patterns are final
        support, most = F.sum((F.col("score") >= MIN_SCORE).cast("long")), F.sum((F.col("score") > 0).cast("long"))
        rated = edges.groupBy("pattern").agg(
            support.alias("support"), most.alias("most"), (F.sum("score") / F.count("*")).alias("confidence"), F.count("*").alias("size"),
        ).where((F.col("most") >= MIN_SUPPORT) & (F.col("most") / F.col("size") >= MIN_CONFIDENCE))
        good = (F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)
        rated = staged(rated.select("pattern", "confidence", "size", good.alias("good")), "pii-rated")
        reliable = rated.where("good").drop("good")
        sure, unsure = rated.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
        if sure == before and (not unsure or rise <= SETTLED):
            break
        before = sure
        votes = attach(edges.select("pattern", "value"), reliable, "pattern", "size", total)
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = staged(votes.groupBy("value").agg((1 - F.exp(miss)).alias("vote")), "pii-scores")
        held = edges.withColumnRenamed("score", "was").join(scores, "value", "left")
        edges = staged(held.select("pattern", "value", F.greatest("was", F.coalesce("vote", F.lit(0.0))).alias("score"), "was"), "pii-edges")
        rise = edges.agg(F.max(F.col("score") - F.col("was"))).first()[0] or 0.0
        edges = edges.drop("was")
    hits = attach(stands.where("kind = 'id'"), reliable, "pattern", "size", total)
    good = staged(scores.where(F.col("vote") >= MIN_SCORE).select("value"), "pii-good")
    return hits.join(good, "value", "left_semi").select("doc_id", "text_key", "start", "end").distinct()


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_id (spans that the method adds)."""
    found = staged(scanned(docs, doc_id, text), "pii-spans")
    extra = discovered(found).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("extra")
    )
    name = lambda kind: lambda s: F.concat_ws(":", kind if isinstance(kind, Column) else F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: name(s["kind"])(s))
    rows = found.select(
        "doc_id", "text_key", base.alias("base"),
        *(_count("base", kind).alias(f"n_{kind}") for kind in RULES),
    )
    both = rows.alias("r").join(extra.alias("x"), F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.text_key") == F.col("x.text_key")), "left")
    more = F.coalesce(F.col("extra"), F.array().cast("array<struct<start:int,end:int>>"))
    return both.select(
        F.col("r.doc_id").alias("doc_id"), *(f"n_{k}" for k in RULES), F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat("base", F.transform(more, name("id"))), ",").alias("spans"), F.size(more).cast("long").alias("n_id"),
    )
