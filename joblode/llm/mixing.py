"""Mixing sources to target weights, with DataFrame operations only.

Leaves are (domain, language, source). A token budget goes down the tree: at each node the children get shares by
weight, none more than its subtree can give (tokens times the epochs allowed); what a child cannot give goes to its
siblings by their weights, and only what all of them cannot give is left to the node's own siblings. Inside a set of
siblings that is a water level: child i gets min(capacity_i, level * weight_i).

A leaf's budget then takes whole epochs, and of one more epoch the longest prefix that fits, in an order seeded by
epoch and document. The order is cut into slices by its leading digits: the sums of slices tell which slice holds the
boundary, and only that slice is looked at more closely, so a leaf with a third of all rows is never in one task.
The tree itself is a table of leaves; a set of siblings is sorted in one task, one narrow row for each child.

Null or empty texts have no tokens and are never selected. A null domain, language or source is a value of its own.
Nodes without a weight get 1; a weight of 0 or less, or null, gives nothing. Rows that repeat an id are ordered and
selected together; rows with a null id are ordered by their text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblode.llm.common import attach, fresh, quoted, staged, with_columns_of

LEVELS = ("domain", "lang", "source")
WEIGHTS = "level int, domain string, lang string, source string, weight double"
DIGITS = 2
SLICE_ROWS = 1000
BLANKS = " \t\n\x0b\f\r"


def token_count(text: str) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(F.coalesce(quoted(text).cast("string"), F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("long")


def path(levels: Sequence[str | Column]) -> Column:
    """A node's place in the tree as text; values are marked so that null differs from every value."""
    values = [F.col(c) if isinstance(c, str) else c for c in levels]
    return F.concat_ws("/", *(F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("null")) for v in values))


def leaf_budgets(leaves: DataFrame, weights: DataFrame, share: float, epochs: int) -> DataFrame:
    """leaves (leaf, domain, lang, source, supply, size) with target: the tokens that each has to give.

    weights: WEIGHTS; lang and source are null above their level. share: of all tokens.
    """
    nodes = leaves
    for level in (1, 2, 3):
        own = weights.where(F.col("level") == level).select(path(LEVELS[:level]).alias(f"p{level}"), F.coalesce("weight", F.lit(0.0)).alias(f"w{level}"))
        nodes = nodes.withColumn(f"p{level}", path(LEVELS[:level])).join(own, f"p{level}", "left").withColumn(f"w{level}", F.coalesce(f"w{level}", F.lit(1.0)))
    alive = (F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0)
    nodes = nodes.withColumn("cap", F.when(alive, F.col("supply") * epochs).otherwise(0).cast("double")).withColumn("p0", F.lit(""))
    nodes = staged(nodes, "mix-nodes")
    parent = nodes.groupBy("p0").agg(F.least(F.floor(F.sum("supply") * share).cast("double"), F.sum("cap")).alias("budget"))
    for level in (1, 2, 3):
        tree = nodes.groupBy(f"p{level}", f"p{level - 1}", f"w{level}").agg(F.sum("cap").alias("cap")).where("cap > 0")
        tree = tree.join(parent, f"p{level - 1}").withColumn("height", F.col("cap") / F.col(f"w{level}"))
        siblings = Window.partitionBy(f"p{level - 1}")
        up, down = siblings.orderBy("height", f"p{level}"), siblings.orderBy(F.desc("height"), F.desc(f"p{level}"))
        tree = tree.withColumn("used", F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        tree = tree.withColumn("open", F.sum(f"w{level}").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # children fill up in the order of their height; the first that does not sets the level
        tree = tree.withColumn("water", (F.col("budget") - F.col("used")) / F.col("open"))
        tree = tree.withColumn("full", F.col("height") <= F.col("water"))
        first = F.min(F.when(~F.col("full"), F.struct("height", f"p{level}", "water"))).over(siblings)["water"]
        tree = tree.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(first, F.lit(0.0)) * F.col(f"w{level}")))
        parent = tree.select(f"p{level}", "budget")
    return nodes.join(parent, "p3", "left").select(
        "leaf", *LEVELS, "supply", "size", F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6).cast("long").alias("target")
    )


def select_mix(
    docs: DataFrame, weights: DataFrame, share: float, epochs: int, seed: int,
    doc_id: str = "doc_id", text: str = "text", domain: Column | str = "domain", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """One row per row of docs: doc_id, domain, lang, source, n_tokens, target (of its leaf), copies (0: not selected)."""
    keyed, cuts, total = _mix(docs, weights, share, epochs, seed, doc_id, text, domain, lang, source)
    taken = attach(keyed, cuts, "leaf", "leaf_size", total)
    copies = F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return taken.select("doc_id", *LEVELS, "n_tokens", "target", F.when(F.col("n_tokens") > 0, copies).otherwise(0).cast("long").alias("copies"))


def _name(doc_id: str, text: str) -> Column:
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    return F.coalesce(quoted(doc_id).cast("string"), F.concat(F.lit("null-"), F.md5(body.cast("binary"))))


def _mix(
    docs: DataFrame, weights: DataFrame, share: float, epochs: int, seed: int,
    doc_id: str, text: str, domain: Column | str, lang: str, source: str,
) -> tuple[DataFrame, DataFrame, int]:
    """The rows with plan and order key, the last key of each leaf's prefix, and the number of rows."""
    rows = docs.select(
        quoted(doc_id).cast("long").alias("doc_id"), _name(doc_id, text).alias("name"), (quoted(domain) if isinstance(domain, str) else domain).cast("string").alias("domain"),
        quoted(lang).cast("string").alias("lang"), quoted(source).cast("string").alias("source"), token_count(text).alias("n_tokens"),
    )
    rows = staged(rows.withColumn("leaf", path(LEVELS)), "mix-rows")
    total = rows.count()
    leaves = rows.groupBy("leaf", *LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("size"))
    plan = leaf_budgets(leaves, weights, share, epochs)
    plan = plan.withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("target") / F.col("supply"))).otherwise(0).cast("long"))
    plan = staged(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("supply")), "mix-plan")
    keyed = attach(rows.select("doc_id", "name", "n_tokens", "leaf"), plan, "leaf", "size", total)
    keyed = staged(keyed.withColumn("key", _key(seed, "whole", "name")), "mix-keys")
    return keyed, _cuts(keyed, plan, total), total


def _key(seed: int, whole: str, name: str) -> Column:
    """32 hexadecimal digits that order the epoch after the whole ones."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), (F.col(whole) + 1).cast("string"), name).cast("binary"))


def _cuts(keyed: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """For each leaf the last key of its prefix: leaf, leaf_size, cut."""
    bounds = plan.select("leaf", F.lit("").alias("prefix"), "rest")
    rounds = max(1, math.ceil(math.log(max(total / SLICE_ROWS, 1.0), 16**DIGITS)))
    inside = keyed.select("leaf", "key", "n_tokens")
    running = Window.partitionBy("leaf").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    for r in range(rounds):
        inside = inside.withColumn("slice", F.substring("key", 1, DIGITS * (r + 1)))
        sums = inside.groupBy("leaf", "slice").agg(F.sum("n_tokens").alias("tokens")).withColumn("upto", F.sum("tokens").over(running))
        held = sums.join(bounds, "leaf").where("upto > rest").groupBy("leaf").agg(F.min(F.struct("slice", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest"))).alias("b"))
        bounds = staged(held.select("leaf", F.col("b.slice").alias("prefix"), F.col("b.rest").alias("rest")), "mix-bounds")
        inside = inside.join(bounds.select("leaf", F.col("prefix").alias("slice")), ["leaf", "slice"], "left_semi")
    last = inside.join(bounds, "leaf").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("leaf").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    ends = last.where("upto <= rest").groupBy("leaf").agg(F.max("key").alias("end"))
    cut = bounds.join(ends, "leaf", "left").select("leaf", F.coalesce("end", "prefix").alias("cut"))
    return staged(plan.select("leaf", F.col("size").alias("leaf_size"), F.col("whole").alias("leaf_whole")).join(cut, "leaf", "left").withColumn("cut", F.coalesce("cut", F.lit(""))), "mix-cuts")


def keep_mix(docs: DataFrame, weights: DataFrame, share: float, seed: int, domain: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that one epoch selects, with their columns.

    A row is judged by its own key and the cut of its leaf, so rows of large leaves do not shuffle.
    """
    _, cuts, total = _mix(docs, weights, share, 1, seed, doc_id, text, domain, lang, source)
    name, leaf, size, whole, cut = fresh(docs, "name", "leaf", "leaf_size", "whole", "cut")
    rows = docs.withColumns({name: _name(doc_id, text), leaf: path([domain, quoted(lang), quoted(source)])})
    ends = cuts.select(F.col("leaf").alias(leaf), F.col("leaf_size").alias(size), F.col("leaf_whole").alias(whole), F.col("cut").alias(cut))
    key = _key(seed, whole, name)
    taken = attach(rows, ends, leaf, size, total).where(((F.col(whole) > 0) | (key <= F.col(cut))) & (token_count(text) > 0))
    return with_columns_of(taken, docs.columns)
