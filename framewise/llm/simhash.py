"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint holds, for each of 64 bits, whether over half of its word shingles' XXH64 hashes
have that bit. Documents whose fingerprints differ in at most ``distance`` bits are linked; a group is a
connected component of links.

Candidate search. Two words within 2r bits of each other always have a common word within r bits of both,
so if every fingerprint emits its radius-r ball, close pairs meet on a shared key. Balls grow fast (all 64
bits, distance 3: 2,081 keys), so the 64 bits are cut into three blocks and the balls are drawn in the word
that remains when one block is left out: of 3 differing bits at least one lies in some block, the other two
blocks then differ in at most 2 bits, and radius 1 suffices: 3 x 44 keys. The keys are shuffled, fingerprints
that share one are deduplicated and verified on all 64 bits.

Only distinct fingerprints are emitted, so copies never form pairs. A key under which more than ``pairs_up_to``
fingerprints meet (a large group of near copies) is not expanded into pairs: its fingerprints emit balls in the
whole 64-bit word, of a radius that depends on the parity of their bit count, such that all that meet under one
key are linked by a star (see :func:`_star_links`). Nothing is capped: both ways find every link's component.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import connected_components, fits_broadcast, own_name, text_or_empty
from framewise.session import cut_lineage

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
BITS, BLOCKS = 64, 3


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 when it has no words. A-Z are lower-cased, shingles of
    ``shingle`` words count as often as they occur, and shorter texts are one shingle."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):  # bounded memory for very long texts
        bits = np.unpackbits(h[i:i + 8192].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of every row, fp as a signed long. Null texts count as empty."""
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def _flips(bits: list[int], radius: int) -> list[int]:
    """XOR masks of the ball of ``radius`` over the given bit positions, as signed longs."""
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in itertools.combinations(bits, r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _kept_masks() -> list[int]:
    """Per part: the bits of all blocks but one."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    return [_signed(sum(1 << b for b in range(BITS) if not edges[p] <= b < edges[p + 1])) for p in range(BLOCKS)]


def _keys(fps: DataFrame, distance: int) -> DataFrame:
    """``(part, key, fp)``: the ball of every fingerprint in each word that leaves one block out."""
    radius = -(-(distance - -(-distance // BLOCKS)) // 2)
    parts = []
    for p, mask in enumerate(_kept_masks()):
        rest = [b for b in range(BITS) if mask >> b & 1]
        keep = F.col("fp").bitwiseAND(F.lit(mask))
        masks = F.array(*[F.lit(m).cast("long") for m in _flips(rest, radius)])
        parts.append(fps.select("fp", keep.alias("w"), F.explode(masks).alias("m")).select(
            F.lit(p).cast("byte").alias("part"), F.col("w").bitwiseXOR(F.col("m")).alias("key"), "fp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, distance: int = 3, pairs_up_to: int = 64) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints (``fps`` has one column ``fp``, no repeats) whose
    components are those of the relation "at most ``distance`` bits apart"."""
    w = Window.partitionBy("part", "key")
    # flips: how the key differs from the fingerprint's own word. Fingerprints with the same word meet under every key
    # of its ball, all with the same flips; the meeting under the word itself is enough.
    keep = F.element_at(F.array(*[F.lit(k).cast("long") for k in _kept_masks()]), F.col("part") + 1)
    flips = F.col("key").bitwiseXOR(F.col("fp").bitwiseAND(keep))
    met = _keys(fps, distance).withColumn("flips", flips).withColumns({
        "n": F.count("*").over(w), "lo": F.min("flips").over(w), "hi": F.max("flips").over(w)})
    met = cut_lineage(met.where("n > 1 and (lo <> hi or flips = 0)").select("part", "key", "fp", "flips", "n"))
    few = met.where(F.col("n") <= pairs_up_to)
    # within a small key: every earlier fingerprint, by windows over at most pairs_up_to rows
    earlier = F.collect_list(F.struct("fp", "flips")).over(w.orderBy("fp").rowsBetween(Window.unboundedPreceding, -1))
    close = F.filter("before", lambda o: ((o["flips"] != F.col("flips")) | (o["flips"] == 0))
                     & (_far(o["fp"], F.col("fp")) <= distance))
    pairs = few.withColumn("before", earlier).select(F.col("fp").alias("src"), F.explode(
        F.transform(close, lambda o: o["fp"])).alias("dst")).distinct()
    many = met.where(F.col("n") > pairs_up_to).select("fp").distinct()
    return pairs.unionByName(_star_links(many, distance))


def _star_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links of a large group without pairs. Fingerprints with an even bit count emit the whole-word ball of
    radius floor(d/2), those with an odd one of radius ceil(d/2). Two that are within d bits meet: if their
    distance is odd their parities differ and the radii add up to at least it, if even both have half of it.
    Under one key, all within floor(d/2) of it are at most d apart, and so is one of the farther (odd) ones
    from every even one; each such set is linked to its smallest member."""
    near, wide = distance // 2, -(-distance // 2)
    odd = F.bit_count("fp") % 2 == 1
    masks = _flips(list(range(BITS)), wide)
    n_near = len(_flips(list(range(BITS)), near))
    array = F.array(*[F.lit(m).cast("long") for m in masks])
    v = (fps.select("fp", F.when(odd, array).otherwise(F.slice(array, 1, n_near)).alias("ms"))
         .select("fp", F.posexplode("ms").alias("i", "m"))
         .select(F.col("fp").bitwiseXOR(F.col("m")).alias("key"), "fp", (F.col("i") < n_near).alias("near")))
    w = Window.partitionBy("key")
    even = F.bit_count("fp") % 2 == 0
    v = v.withColumns({"hub": F.min(F.when(F.col("near"), F.col("fp"))).over(w),
                       "even_hub": F.min(F.when(even, F.col("fp"))).over(w)})
    to = F.when(F.col("near"), F.col("hub")).otherwise(F.col("even_hub"))
    return v.select(F.col("fp").alias("src"), to.alias("dst")).where(
        F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """One row per input row: ``(id, fp, component_id, root)``.

    component_id is the smallest id in the row's group (ignoring null ids; null if all are null), ``root`` the
    group's smallest fingerprint. Rows with the same fingerprint, whatever their ids, are one group; null and
    wordless texts have fingerprint 0 and are linked like any other. An empty table gives no rows.
    """
    return _grouped(cut_lineage(fingerprints(docs, id_col, text_col, shingle)), distance)


def _grouped(rows: DataFrame, distance: int) -> DataFrame:
    """:func:`near_duplicates` of checkpointed ``(id, fp)``."""
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    comp = connected_components(links(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = classes.join(comp, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    table = rooted.select("fp", "root").join(groups, "root")
    return rows.join(table, "fp").select("id", "fp", "component_id", "root")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         distance: int = 3) -> DataFrame:
    """``docs`` with one row per group: that with the group's smallest id (of its rows, the smallest
    fingerprint; of equal rows, one). The columns stay as they are."""
    marked = cut_lineage(_with_fingerprint(docs, text_col, shingle))
    fp = marked.columns[-1]
    rows = _grouped(marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp")), distance)
    first = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min("id").alias("keep_id"), F.min("fp").alias("keep_fp")).select("keep_id", "keep_fp")
    # rows that share id and fingerprint are few: only they are shuffled whole
    again = marked.groupBy(F.col(id_col).alias("keep_id"), F.col(fp).alias("keep_fp")).count().where("count > 1").drop("count")

    def among(table: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(table) if fits_broadcast(table) else table,
                         rows[id_col].eqNullSafe(table["keep_id"]) & (rows[fp] == table["keep_fp"]), how)
    again = cut_lineage(again)
    kept = among(cut_lineage(first), marked, "left_semi")
    return among(again, kept, "left_anti").unionByName(among(again, kept, "left_semi").dropDuplicates([id_col, fp])).drop(fp)


def _with_fingerprint(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    name = own_name(docs, "fp")

    @F.pandas_udf("long")
    def fp(t: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in t], np.uint64).view(np.int64))

    return docs.withColumn(name, fp(text_or_empty(F.col(text_col))))
