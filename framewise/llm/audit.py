"""How filters on whole texts interact, decided on a sparse document-term matrix.

The matrix. Words are globally dictionary-encoded and documents are rows of CSR shards:

1. every task cuts its documents into shards of about ``shard_bytes`` of text, counts words per document and numbers a
   shard's distinct words; the shard (row pointers, local word numbers, counts) is checkpointed;
2. only a shard's distinct words move, dealt by hash into buckets whose number follows the size of all texts, so a word
   that is everywhere costs one entry a shard; a bucket numbers its words, the bucket sizes' prefix sums make the numbers
   dense over all buckets, and each shard gets the numbers of its words back;
3. a shard's local numbers are replaced by the global ones: ``indptr``, ``indices``, ``data`` over one column space.

A document's word count is its row's sum, its number of distinct words its row's nonzero count.

The audit. Five conditions make a document's failure mask: A and B from the matrix, C and D from characters, E from the
smallest id among equal texts (a combined minimum per text digest, joined back; Spark splits the join where a text is in
very many documents). What a sequence of filters removes depends on the masks alone, so documents are summed by part, mask
and label, and the 120 orders are worked out on at most 32 masks a part.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import join_checked, text_or_empty
from framewise.llm.textbytes import packed, pieces, unpacked
from framewise.session import cut_lineage

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


class Numbers(dict):
    """Gives every new key the next number."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


class TermMatrix(NamedTuple):
    """``shards``: (shard, rows, indptr, indices, data), a row per CSR shard; ``rows`` holds the kept columns of its documents.
    ``terms``: (term, column) of all words, columns dense from 0. ``n_columns``: their number."""

    shards: DataFrame
    terms: DataFrame
    n_columns: int


def term_matrix(docs: DataFrame, text_col: str = "text", keep: dict[str, Column] | None = None, shard_bytes: int = 16 << 20,
                bucket_bytes: int = 32 << 20) -> TermMatrix:
    """The document-term matrix of whole texts (words ``[^\\x20\\x09-\\x0D]+``, case-sensitive). ``keep``: columns, by new
    name, that go along with each row. Null and empty texts are rows without entries; an empty table has no shards. A text
    is never divided over shards; a very long one is counted in pieces."""
    keep = keep or {}
    src = docs.select(*[c.alias(n) for n, c in keep.items()], text_or_empty(F.col(text_col)).cast("binary").alias("_text"))
    total = src.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    kept = ", ".join(f"`{n}`: {src.schema[n].dataType.simpleString()}" for n in keep) or "_row: boolean"
    local = cut_lineage(src.mapInArrow(
        _local_shards(len(keep), buckets, shard_bytes),
        f"shard long, rows array<struct<{kept}>>, indptr binary, indices binary, data binary, "
        "words array<struct<bucket: int, blob: binary>>"))
    words = local.select("shard", F.inline("words"))
    codes = cut_lineage(words.groupBy("bucket").applyInPandas(_bucket_codes, "shard long, bucket int, codes binary, n int"))
    # one number per bucket, so at most one per bucket_bytes of text, whatever the number of words
    sizes = dict(codes.groupBy("bucket").agg(F.first("n")).collect())
    ends = np.cumsum([sizes.get(b, 0) for b in range(buckets)])
    first = ends - [sizes.get(b, 0) for b in range(buckets)]
    shards = (local.drop("words").groupBy("shard").cogroup(codes.select("shard", "bucket", "codes").groupBy("shard"))
              .applyInArrow(_global_shard(first), f"shard long, rows array<struct<{kept}>>, indptr array<long>, "
                            "indices array<long>, data array<int>"))
    terms = words.groupBy("bucket").applyInPandas(_bucket_terms(first), "term string, column long")
    return TermMatrix(shards, terms, int(ends[-1]) if len(ends) else 0)


def _local_shards(n_keep: int, buckets: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        vocabulary, indptr, indices, data, rows, size = Numbers(), array("q", [0]), array("i"), array("i"), [], 0
        for batch in batches:
            text, begin = batch.column(n_keep), 0
            for k in range(batch.num_rows):
                raw = text[k].as_py()
                counts: Counter = Counter()
                for piece in pieces(raw):
                    counts.update(piece.split())
                indices.extend(map(vocabulary.__getitem__, counts))
                data.extend(counts.values())
                indptr.append(len(indices))
                size += len(raw)
                if size >= shard_bytes:
                    rows.append(_kept(batch, begin, k + 1, n_keep))
                    yield _local_shard(number, rows, indptr, indices, data, vocabulary, buckets)
                    number, begin = number + 1, k + 1
                    vocabulary, indptr, indices, data, rows, size = Numbers(), array("q", [0]), array("i"), array("i"), [], 0
            if begin < batch.num_rows:
                rows.append(_kept(batch, begin, batch.num_rows, n_keep))
        if rows:
            yield _local_shard(number, rows, indptr, indices, data, vocabulary, buckets)
    return run


def _kept(batch: pa.RecordBatch, begin: int, end: int, n_keep: int) -> pa.StructArray:
    part = batch.slice(begin, end - begin)
    if not n_keep:
        return pa.StructArray.from_arrays([pa.array([True] * (end - begin))], ["_row"])
    return pa.StructArray.from_arrays([part.column(i) for i in range(n_keep)], batch.schema.names[:n_keep])


def _local_shard(number, rows, indptr, indices, data, vocabulary, buckets) -> pa.RecordBatch:
    """A shard as one row; its words are renumbered in bucket order, so that a bucket's words are a range."""
    words = list(vocabulary)
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(words)]
    by_bucket = [{"bucket": int(bucket[order[a]]), "blob": b" ".join([words[i] for i in order[a:b].tolist()])}
                 for a, b in zip(cuts, cuts[1:]) if a < b]
    structs = pa.concat_arrays(rows)
    local = place[np.frombuffer(indices, np.int32)] if len(indices) else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs),
         pa.array([packed(np.frombuffer(indptr, np.int64))], pa.binary()), pa.array([packed(local)], pa.binary()),
         pa.array([packed(np.array(data, np.int32))], pa.binary()),
         pa.array([by_bucket], pa.list_(pa.struct([("bucket", pa.int32()), ("blob", pa.binary())])))],
        names=["shard", "rows", "indptr", "indices", "data", "words"])


def _numbered(g: pd.DataFrame) -> tuple[Numbers, list[np.ndarray]]:
    vocabulary = Numbers()
    codes = []
    for blob in g["blob"]:
        words = bytes(blob).split()
        codes.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
    return vocabulary, codes


def _bucket_codes(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("shard", ignore_index=True)
    vocabulary, codes = _numbered(g)
    return pd.DataFrame({"shard": g["shard"], "bucket": g["bucket"], "codes": [packed(c) for c in codes], "n": len(vocabulary)})


def _bucket_terms(first: np.ndarray):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        vocabulary, _ = _numbered(g.sort_values("shard", ignore_index=True))
        at = int(first[g["bucket"].iloc[0]])
        return pd.DataFrame({"term": [w.decode("utf-8", "replace") for w in vocabulary], "column": range(at, at + len(vocabulary))})
    return run


def _global_shard(first: np.ndarray):
    def run(shard: pa.Table, codes: pa.Table) -> pa.Table:
        codes = codes.sort_by("bucket")
        column = np.concatenate([np.zeros(0, np.int64)] + [unpacked(c, np.int32) + first[b] for b, c in
                                                           zip(codes["bucket"].to_pylist(), codes["codes"].to_pylist())])
        out = {n: unpacked(shard[n][0].as_py(), t) for n, t in (("indptr", np.int64), ("indices", np.int32), ("data", np.int32))}
        out["indices"] = column[out["indices"]]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in out.values()]
        return pa.table([shard["shard"], shard["rows"], *lists], names=["shard", "rows", *out])
    return run


def row_statistics(shards: DataFrame) -> DataFrame:
    """The kept columns of every document with ``n_words`` (its row's sum) and ``n_distinct`` (its row's nonzero count)."""
    fields = shards.schema["rows"].dataType.elementType.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long", "n_distinct long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, indptr, data = (batch.column(i)[k].values for i in range(3))
                at, sums = indptr.to_numpy(), np.append(0, np.cumsum(data.to_numpy(zero_copy_only=False), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(np.diff(at))],
                                                 names=[*(f.name for f in rows.type), "n_words", "n_distinct"])

    return shards.select("rows", "indptr", "data").mapInArrow(run, schema)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **options) -> DataFrame:
    """``(id, part, mask)`` of every row, checkpointed: bit i of the mask is set where the i-th filter of ABCDE fails.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 2% of the code points are A-Z. D: holds one of
    ``#$%&*|``. E: identical to the text of a smaller id. Null texts are empty, a null part is the empty string; a null id is
    never after another. Rows with the same id are judged each, and do not make each other fail E."""
    text = text_or_empty(F.col(text_col))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    keep = {"id": F.col(id_col), "part": F.coalesce(F.col(part_col).cast("string"), F.lit("")), "h": F.unhex(F.sha2(text.cast("binary"), 256)),
            "c": 100 * upper.cast("long") > 2 * F.char_length(text), "d": text.rlike("[#$%&*|]")}
    rows = row_statistics(term_matrix(docs, text_col, keep, **options).shards)
    flags = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("c"), F.col("d")]
    own = cut_lineage(rows.select("id", "part", "h", _bits(flags).alias("mask")))
    # a table of its own: Spark splits a hot text's rows only if no aggregate stands between the exchange and the join
    first = cut_lineage(own.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return join_checked(own, first, "h", "left").select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def _bits(flags: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          **options) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: for every part,
    every order of the five filters and every step of it, how many of the part's documents stay after the step, go at it, fail
    its filter but went earlier, fail no other filter, go although labelled good or toxic, and the filter's removals summed
    over all orders. A document with several label rows is good (toxic) if any says so. An empty table gives no rows."""
    masks = failure_masks(docs, id_col, text_col, part_col, **options)
    label = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    cells = masks.join(label, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    steps = (parts.select("part", "cells", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    now = F.substring("filter_order", F.col("step"), F.lit(1))
    s = steps.withColumn("before", _bits([F.contains(before, F.lit(f)) for f in FILTERS])).withColumn(
        "now", _bits([now == f for f in FILTERS]))

    def total(value, test) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.when(test(c["mask"]), value(c)).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("now")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    # in 120 / k of the orders a given one of k failing filters comes first
    turns = lambda c: (c["n"] * F.lit(len(ORDERS)) / F.bit_count(c["mask"])).cast("long")
    return s.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total(lambda c: c["n"], lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(lambda c: c["n"], here).alias("removed"), total(lambda c: c["n"], lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == F.col("now")).alias("unique_fails"), total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"), total(turns, fails).alias("shapley"))
