"""Mixing sources to target weights with DataFrame functions only.

Every document gets a hash-random key; within its source, keys are range-sorted (4,096 fixed ranges of a uniform
hash, so a source with a third of all rows is spread evenly), prefix sums of the words run over the ranges'
sums and inside each range, and the source is cut at the key where its budget is reached. Budgets above the
source's size repeat whole epochs first. The cut is one row per source, so applying it moves no text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import join_checked, own_name, word_count
from framewise.session import cut_lineage


def mix_key(id_col: str, seed: str) -> Column:
    """The hash-random key of a document: hexadecimal text, so its first digits are its range."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order (null last) take the ``weights`` in turn and share ``share`` of all words; a
    target stops at ``max_epochs`` times its source and the excess is shared again by weight until none is
    above. A round is one aggregate; the driver holds two sums. If all sources reach their limit, all stop
    there.
    """
    at = _positions(sizes)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = cut_lineage(at.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_epochs).alias("cap")))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    goal, level, before = share * total, None, -1
    while True:  # the level (words per unit of weight) rises as sources reach their limit
        full = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("w")
        n, capped, rest = t.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))),
                                F.sum(F.when(~full, F.col("w")))).first()
        if rest is None or n == before:
            break
        before, level = n, (goal - (capped or 0)) / rest
    if level is None:
        level = 0.0
    return t.select("source", "source_size",
                    F.least(F.col("w") * F.lit(float(level)), F.col("cap").cast("double")).alias("target")) \
        if rest is not None or total == 0 else t.select("source", "source_size", F.col("cap").cast("double").alias("target"))


def _positions(sizes: DataFrame) -> DataFrame:
    """Sources numbered in code point order, null last, without one task for all of them: sorted into ranges,
    counted per range, numbered inside each."""
    s = cut_lineage(sizes.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source")
                    .withColumn("part", F.spark_partition_id()))
    first = {r["part"]: r["n"] for r in s.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, seen = [], 0
    for p in sorted(first):  # one number per partition
        starts.append((p, seen))
        seen += first[p]
    offset = F.lit(0)
    if starts:
        offset = F.element_at(F.create_map(*[F.lit(x) for p in starts for x in p]), F.col("part"))
    w = Window.partitionBy("part").orderBy("none", "source")
    return s.select("source", "source_size", (offset + F.row_number().over(w) - 1).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix",
        size_col: str | None = None) -> DataFrame:
    """``docs`` with columns ``size, source_size, target, taken, copies`` (names with ``_`` appended if taken).

    ``taken``: words the mix takes of the document, repeats counted: whole epochs plus, up to the source's cut,
    one more time; the document at the cut gives the words that are missing, so a source's taken words are its
    target rounded. Rows that share the key at the cut (repeated ids) share what is missing in proportion to
    their sizes, rounded down. ``copies``: the same as whole documents (the one at the cut counts if at least
    half of it is taken). Null and wordless texts have size 0, take 0 words and are copied like a neighbour;
    null is a source of its own. ``size_col`` names a column of word counts to use instead of
    the text. Same input, same result, whatever the partitioning.
    """
    names = {n: own_name(docs, n) for n in ("size", "source_size", "target", "taken", "copies")}
    key, src = own_name(docs, "mix_key"), own_name(docs, "mix_source")
    d = docs.withColumns({names["size"]: F.col(size_col) if size_col else word_count(F.col(text_col)), key: mix_key(id_col, seed)})
    slim = cut_lineage(d.groupBy(F.col(source_col).cast("string").alias("source"), F.col(key).alias("key"))
                       .agg(F.sum(names["size"]).alias("words")))
    ranges = slim.groupBy("source", F.substring("key", 1, 3).alias("range")).agg(F.sum("words").alias("words"))
    ranges = cut_lineage(ranges)
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")),
                             weights, share, max_epochs)
    budget = F.round("target").cast("long")
    plan = cut_lineage(targets.withColumn("budget", budget).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.col("budget") - F.col("epochs") * F.col("source_size")))
    by = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "range", F.coalesce(F.sum("words").over(by), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    sums = slim.withColumn("range", F.substring("key", 1, 3)).withColumn("upto", F.sum("words").over(inside))
    same = lambda a, b, c: a[c].eqNullSafe(b[c])  # noqa: E731  null is a source like any other
    prefix = sums.join(starts, same(sums, starts, "source") & (sums["range"] == starts["range"])).select(
        sums["source"], "key", "words", (F.col("start") + F.col("upto")).alias("upto"))
    cut = join_checked(prefix, plan, same(prefix, plan, "source")).where(
        (F.col("upto") - F.col("words") < F.col("need")) & (F.col("need") <= F.col("upto"))).select(
        prefix["source"], F.col("key").alias("cut_key"), F.col("words").alias("cut_words"),
        (F.col("need") - F.col("upto") + F.col("words")).alias("cut_need"))
    cuts = cut_lineage(plan.join(cut, same(plan, cut, "source"), "left").select(
        plan["source"].alias(src), F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]), "epochs", "cut_key", "cut_words", "cut_need"))
    out = join_checked(d, cuts, d[source_col].cast("string").eqNullSafe(cuts[src]))
    size = F.col(names["size"])
    at_cut = F.floor(F.col("cut_need") * size / F.col("cut_words")).cast("long")
    more = F.when(cuts["cut_key"].isNull() | (d[key] > cuts["cut_key"]), F.lit(0)).when(
        d[key] < cuts["cut_key"], size).otherwise(at_cut).cast("long")
    taken = F.col("epochs") * size + more
    copies = F.when(size > 0, F.floor((2 * taken + size) / (2 * size))).otherwise(
        F.col("epochs") + F.when(d[key] < cuts["cut_key"], 1).otherwise(0)).cast("long")
    return out.select(*[d[c] for c in docs.columns], d[names["size"]], names["source_size"], names["target"],
                      taken.alias(names["taken"]), copies.alias(names["copies"]))


def draw(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as many times as the mix copies it, in the columns of ``docs``."""
    m = mix(docs, **options)
    copies, each = m.columns[-1], own_name(m, "copy")
    return m.where(F.col(copies) > 0).withColumn(
        each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
