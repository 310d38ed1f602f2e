"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines are compared by their sets of ``shingle``-character strings (a shorter line is one string). Steps:

1. Signatures. Every shingle is hashed once to 32 bits; position p of the signature is the smallest ``hash XOR c[p]``,
   taken over STEP shingles in a row before the rows of a line are combined.
   A random hash XOR a constant is as random, so two lines agree at a position with probability equal to their Jaccard
   similarity. The constants start with different bits, so each position looks at another part of the hash range. The
   minima are plain aggregates, combined before the shuffle: no text moves.
2. Banding. The 16 positions form a 4 x 4 grid; its rows, columns and the four diagonals ``column = row XOR s`` are
   12 bands of 4. The bands share the 16 positions, so they are not independent: simulated, a pair at similarity 0.8
   misses all bands with probability 0.014 at 40 shingles and 0.020 from 100 on.
3. Verification. Lines that share a band are verified on their whole shingle sets (as 64-bit hashes). First every line of a band group is
   compared with the smallest, then, in groups of more than one component, the lines of other components with a line
   drawn by hash; what still is in more than one component is compared across components (:func:`_across`). Lines of
   one component need no more pairs. Two cheap tests come before: pairs whose
   signatures agree at fewer than half of the positions (judged by 4 bits of each, a long in all) are not verified; at
   similarity 0.8 that happens to 1 pair in 1,000. And a line's set is dealt once to 1,024 parity bits, whose difference
   bounds that of the sets from below; pairs beyond what similarity 0.8 allows are out, without loss.
4. Union-find over the links (:func:`framewise.llm.common.connected_components`) and one line kept per component: that of
   the smallest (id, hash of the text, line number), null ids last. Rows with the same id and text are one document
   repeated and fare alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import connected_components, join_checked, more_components, own_name, text_or_empty
from framewise.session import cut_lineage

GRID = 4
LEAST = 8  # signature positions that must agree for a pair to be verified
TURNS = 1  # further times that band groups of several components are compared with one of their lines
STEP = 4  # shingles of a line that are hashed, or dealt to parity bits, in one row
WORDS = 16  # 64-bit words of a line's parity bits
BLOCK = 1024  # lines of a band group that meet the whole group in one task


def _constants() -> list[int]:
    """One 32-bit constant per signature position; the first four bits are the position."""
    low = np.random.default_rng(17).integers(0, 1 << 28, GRID * GRID)
    return [int(np.int32(np.uint32(p << 28 | int(x)))) for p, x in enumerate(low)]


def _bands() -> list[list[int]]:
    n = range(GRID)
    return ([[GRID * r + c for c in n] for r in n] + [[GRID * r + c for r in n] for c in n]
            + [[GRID * r + (r ^ s) for r in n] for s in n])


def _blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\r\x0b\x0c")) == ""  # from the left only: it stops at the first other character


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, h, line_no, line, id)``: the lines of every document that are not blank, with h the hash that tells
    texts of one id apart and id the line's 64-bit hash."""
    t = text_or_empty(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(t).alias("h"), F.posexplode(F.split(t, "\n")).alias("line_no", "line")
                       ).where(~_blank(F.col("line"))).withColumn("id", F.xxhash64("line"))


def line_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, h, ids)`` per row of ``docs``, checkpointed: the ids of :func:`line_rows` of all its lines in order, null for
    a blank one. Line numbers and counts come from it, so that texts are not split again for them."""
    t = text_or_empty(F.col(text_col))
    ids = F.transform(F.split(t, "\n"), lambda line: F.when(~_blank(line), F.xxhash64(line)))
    return cut_lineage(docs.select(F.col(id_col).alias("doc"), F.xxhash64(t).alias("h"), ids.alias("ids")))


def _last(code: Column, shingle: int) -> Column:
    """Where the last shingle of a UTF-16 coded line starts, in characters from 0."""
    return F.greatest(F.shiftright(F.octet_length(code), 1) - shingle, F.lit(0)).cast("int")


def _cut(code: Column, at: Column, shingle: int) -> Column:
    return F.substring(code, 2 * at + 1, F.lit(2 * shingle))


def signatures(lines: DataFrame, shingle: int) -> DataFrame:
    """``(id, m0 .. m15)`` per distinct line."""
    coded = lines.select("id", F.encode("line", "UTF-16BE").alias("code")).withColumn("last", _last(F.col("code"), shingle))
    at = F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("at")
    starts = [F.least(F.col("at") + i, F.col("last")) for i in range(STEP)]  # the last shingle again changes no minimum
    hashed = coded.select("id", "code", "last", at).select(
        "id", *[F.hash(_cut(F.col("code"), start, shingle)).alias(f"x{i}") for i, start in enumerate(starts)])
    least = [F.least(*[F.col(f"x{i}").bitwiseXOR(F.lit(c)) for i in range(STEP)]) for c in _constants()]
    return hashed.groupBy("id").agg(*[F.min(x).alias(f"m{p}") for p, x in enumerate(least)])


def _meetings(sig: DataFrame) -> DataFrame:
    """``(band, id, sketch, n)``: the lines that share a band with another one, n in all; the sketch holds 4 bits of
    each signature position."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{p}") for p in ps]) for b, ps in enumerate(_bands())])
    sketch = F.lit(0).cast("long")
    for p in range(GRID * GRID):
        sketch = sketch.bitwiseOR(F.shiftleft(F.col(f"m{p}").bitwiseAND(F.lit(15)).cast("long"), 4 * p))
    rows = sig.select("id", sketch.alias("sketch"), F.explode(keys).alias("band"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where(F.col("n") > 1)


def _alike(a: Column, b: Column) -> Column:
    """Whether enough of the sixteen 4-bit digits agree."""
    x = a.bitwiseXOR(b)
    for shift in (2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))) <= GRID * GRID - LEAST


def _first_pairs(met: DataFrame) -> DataFrame:
    first = F.first(F.struct("id", "sketch")).over(Window.partitionBy("band").orderBy("id"))
    return met.withColumn("o", first).where((F.col("o.id") != F.col("id")) & _alike(F.col("o.sketch"), F.col("sketch"))).select(
        F.col("o.id").alias("a"), F.col("id").alias("b")).distinct()


def _mixed(met: DataFrame, comp: DataFrame) -> DataFrame:
    """``(band, id, sketch, n, c)``: the band groups that :func:`_first_pairs` did not cover wholly and whose lines are in
    more than one component."""
    at = join_checked(met.where(F.col("n") > 2), comp, "id", "left").select(
        "band", "id", "sketch", "n", F.coalesce("component", "id").alias("c"))
    w = Window.partitionBy("band")
    return at.withColumns({"lo": F.min("c").over(w), "hi": F.max("c").over(w)}).where("lo <> hi").drop("lo", "hi")


def _again(mixed: DataFrame, turn: int) -> DataFrame:
    """``(a, b)``: in every mixed band group, one line drawn by hash and the lines of other components."""
    hub = F.first(F.struct("id", "sketch", "c")).over(Window.partitionBy("band").orderBy(F.xxhash64("id", F.lit(turn)), "id"))
    return mixed.withColumn("o", hub).where((F.col("o.c") != F.col("c")) & _alike(F.col("o.sketch"), F.col("sketch"))).select(
        F.least("o.id", "id").alias("a"), F.greatest("o.id", "id").alias("b")).distinct()


def _shingles(line: str, shingle: int) -> Column:
    """The 64-bit hashes of the ``shingle``-character strings of a line, repeats included; a shorter line is one. Sets of
    numbers are built and met several times as fast as sets of strings. The line is coded in 4 bytes a character, so that
    each string is a slice; the coded line is a lambda's variable, as a column would be copied for every slice."""
    width = 4 * shingle

    def hashes(code: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(code) - (width - 1), F.lit(1)), F.lit(4))
        return F.transform(starts, lambda at: F.xxhash64(F.substring(code, at, F.lit(width))))

    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), hashes), F.lit(0))


def _parities(text: DataFrame, shingle: int) -> DataFrame:
    """``(id, size, odd)``: a line's number of different shingles, and these dealt to 64 * WORDS bits, each the parity
    of its members. Where two sets differ in k members, their parities differ in at most k bits. A row holds STEP
    shingles before the rows of a line are combined."""
    def word(i: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(STEP):
            out = out.bitwiseXOR(F.when(F.col(f"at{k}") == i, F.col(f"bit{k}")).otherwise(F.lit(0).cast("long")))
        return F.bit_xor(out).alias(f"w{i}")

    def dealt(k: int) -> list[Column]:
        x = F.col(f"x{k}")  # null behind the last shingle: no bit, in no word
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 8).bitwiseAND(F.lit(63)).cast("int"))
        return [F.coalesce(x.bitwiseAND(F.lit(WORDS - 1)).cast("int"), F.lit(-1)).alias(f"at{k}"),
                F.coalesce(bit, F.lit(0).cast("long")).alias(f"bit{k}")]

    sets = text.select("id", F.array_distinct(_shingles("line", shingle)).alias("s"))
    rows = sets.select("id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(STEP))).alias("at")).select(
        "id", F.least(F.size("s") - F.col("at"), F.lit(STEP)).alias("n"),
        *[F.get("s", F.col("at") + i).alias(f"x{i}") for i in range(STEP)]).select(
        "id", "n", *[c for k in range(STEP) for c in dealt(k)])
    return rows.groupBy("id").agg(F.sum("n").alias("size"), *[word(i) for i in range(WORDS)]).select(
        "id", "size", F.struct(*[f"w{i}" for i in range(WORDS)]).alias("odd"))


def _near(x: str, y: str, similarity: float) -> Column:
    """Whether the parities of two rows allow as few differences as the similarity asks: an exact bound."""
    total = F.col(f"{x}.size") + F.col(f"{y}.size")
    apart = sum(F.bit_count(F.col(f"{x}.odd.w{i}").bitwiseXOR(F.col(f"{y}.odd.w{i}"))) for i in range(WORDS))
    return apart <= total - 2 * _least(total, similarity)


def _least(total: Column, similarity: float) -> Column:
    """The smallest intersection of two sets of ``total`` members in all that are similar enough."""
    return F.ceil(total * (similarity / (1 + similarity)) - 1e-9)


def _near_pairs(pairs: DataFrame, odd: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, total)``: the pairs ``(a, b)`` that the parity bound allows, with the sum of their sizes."""
    two = pairs.join(odd.select(F.col("id").alias("a"), F.struct("size", "odd").alias("x")), "a").join(
        odd.select(F.col("id").alias("b"), F.struct("size", "odd").alias("y")), "b")
    return two.where(_near("x", "y", similarity)).select("a", "b", (F.col("x.size") + F.col("y.size")).alias("total"))


def _across(mixed: DataFrame, odd: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, total)``: the pairs of lines of different components in the mixed band groups that signature digits and
    parity bound allow, each in the first of the groups that it shares. Only rows of about 200 bytes meet, not texts or
    sets; a group of n lines is dealt to ``n / BLOCK`` parts, each of which meets all of the group, so a hot group is
    many tasks."""
    keys = mixed.groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("keys"))
    rows = mixed.join(odd.join(keys, "id"), "id")
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    kept = F.struct("id", "c", "sketch", "size", "odd", "keys")
    l = rows.select("band", F.pmod(F.xxhash64("id"), parts).alias("part"), kept.alias("x"))
    r = rows.select("band", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), kept.alias("y"))
    met = l.join(r, ["band", "part"]).where(
        (F.col("x.c") < F.col("y.c")) & _alike(F.col("x.sketch"), F.col("y.sketch")) & _near("x", "y", similarity)
        & (F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0)) == F.col("band")))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.size") + F.col("y.size")).alias("total"))


def _verified(pairs: DataFrame, text: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``(src, dst)`` of ``(a, b, total)`` whose shingle sets are similar enough. Only the lines in pairs move."""
    two = pairs.join(text.withColumnsRenamed({"id": "a", "line": "line_a"}), "a").join(
        text.withColumnsRenamed({"id": "b", "line": "line_b"}), "b")
    both = F.size(F.array_intersect(_shingles("line_a", shingle), _shingles("line_b", shingle)))
    return two.where(both >= _least(F.col("total"), similarity)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def line_components(lines: DataFrame, shingle: int = 8, similarity: float = 0.8) -> DataFrame:
    """``(id, component)`` of the distinct lines that have a near duplicate."""
    met = cut_lineage(_meetings(signatures(lines, shingle)))
    ids = cut_lineage(met.select("id").distinct())
    text = cut_lineage(join_checked(lines.select("id", "line"), ids, "id", "left_semi").groupBy("id").agg(
        F.first("line").alias("line")))
    odd = cut_lineage(_parities(text, shingle))
    tried = _near_pairs(_first_pairs(met), odd, similarity)
    found = cut_lineage(_verified(tried, text, shingle, similarity))
    comp = connected_components(found)
    for turn in range(TURNS + 1):
        mixed = cut_lineage(_mixed(met, comp.withColumnRenamed("node", "id")))
        if mixed.isEmpty():
            break
        pairs = _near_pairs(_again(mixed, turn), odd, similarity) if turn < TURNS else _across(mixed, odd, similarity)
        comp = more_components(comp, cut_lineage(_verified(pairs, text, shingle, similarity)))
    return comp.withColumnRenamed("node", "id")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 8,
               similarity: float = 0.8, ids: DataFrame | None = None) -> DataFrame:
    """``(doc, h, keep)``: per document (id and hash of its text) the numbers of the lines that stay, in order.
    Documents none of whose lines stay do not appear. ``ids`` are the :func:`line_ids` of ``docs``, if there already."""
    comp = cut_lineage(line_components(line_rows(docs, id_col, text_col), shingle, similarity))
    ids = line_ids(docs, id_col, text_col) if ids is None else ids
    lines = ids.select("doc", "h", F.posexplode("ids").alias("line_no", "id")).where(F.col("id").isNotNull())
    where = F.struct(F.col("doc").isNull().alias("none"), "doc", "h", "line_no")
    first = join_checked(lines, comp, "id", "left").groupBy(
        F.coalesce("component", "id").alias("root")).agg(F.min(where).alias("at"))
    return first.groupBy("at.doc", "at.h").agg(F.sort_array(F.collect_list("at.line_no")).alias("keep"))


def _join_kept(docs: DataFrame, id_col: str, text_col: str, carried: DataFrame | None = None, **options) -> tuple[DataFrame, str]:
    """``carried`` (by default ``docs``, with the texts) and the numbers of the lines that stay. Its column ``text_hash``
    is the text's hash."""
    h = own_name(docs, "text_hash")
    d = docs if carried is None else carried
    d = d if h in d.columns else d.withColumn(h, F.xxhash64(text_or_empty(F.col(text_col))))
    keep = own_name(d, "keep")
    kept = kept_lines(docs, id_col, text_col, **options).withColumnsRenamed({"doc": "_doc", "h": "_h", "keep": keep})
    out = d.join(kept, d[id_col].eqNullSafe(kept["_doc"]) & (d[h] == kept["_h"]), "left")
    return out.select(*[d[c] for c in d.columns if c != h], F.coalesce(F.col(keep), F.array().cast("array<int>")).alias(keep)), keep


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, n_lines, n_removed, kept_lines)`` per row: lines that are not blank, how many of them go, and the
    numbers (from 0, blank ones counted) of those that stay. Null and empty texts have no lines."""
    n, = (own_name(docs, "n_lines"),)
    slim = docs.select(id_col, text_col)
    ids = line_ids(slim, id_col, text_col)
    counted = F.size(F.filter("ids", lambda x: x.isNotNull())).cast("long").alias(n)
    carried = ids.select(F.col("doc").alias(id_col), counted, F.col("h").alias(own_name(slim, "text_hash")))  # no text moves
    out, keep = _join_kept(slim, id_col, text_col, carried, ids=ids, **options)
    return out.select(
        id_col, n, (F.col(n) - F.size(keep)).alias("n_removed"), F.col(keep).alias("kept_lines"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each text's duplicate lines taken out; blank lines and the order stay, a text that loses nothing
    stays as it is (null stays null), and a text that loses all becomes empty. A column ``n_chars`` follows the text."""
    out, keep = _join_kept(docs, id_col, text_col, **options)
    lines = F.split(F.col(text_col), "\n")
    stay = F.filter(lines, lambda line, i: _blank(line) | F.array_contains(F.col(keep), i))  # the text is split once
    text = F.when(F.size(F.col(keep)) > 0, F.array_join(stay, "\n")).when(
        F.col(text_col).isNotNull() & ~F.col(text_col).rlike(r"[^ \t\r\x0b\x0c\n]"), F.col(text_col)).when(F.col(text_col).isNotNull(), F.lit(""))
    out = out.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(
            F.char_length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
