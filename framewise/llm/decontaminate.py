"""Benchmark passages inside documents, by Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The patterns are the windows of
``window`` consecutive words of every benchmark item; an item with fewer words, but not none, is one shorter window.
The patterns of one length m are searched together. The symbols are words and a block is two of them (one if m = 1):

* the shift table says for each block how far the search window may move to the right so that the block's last place
  in any pattern comes under it; a block that no pattern holds lets the window move m - 1 words at once;
* where the shift is 0, the block ends some pattern: the bucket of that suffix holds those patterns, hashed by their
  words, so that a word pair at the end of very many patterns costs no more than any other;
* the window's words are compared with the pattern directly; each occurrence is a span of document words.

The benchmark is a stated query set: it is read in blocks of at most ``block_words`` words, the only thing that is sent
to the executors, and every block is searched in all documents. Documents never move when there is one block; with more,
only the spans found do (grouped by document). Long texts are read in pieces, and long items dealt over blocks, that
overlap by one word less than a window, so that no occurrence is lost and none is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import text_or_empty
from framewise.llm.textbytes import pieces

# A-Z become a-z; every other byte that no word holds becomes a space.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
                  for b in range(256))
SPAN = "array<struct<start:long,end:long>>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TO_WORDS).split()


class Patterns:
    """The search tables of all patterns of ``length`` words. ``windows``: pattern -> numbers of the items that have it."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], tuple[int, ...]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], tuple[int, ...]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                b = window[end - self.block:end]
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.buckets.setdefault(window[-self.block:], {})[window] = items

    def search(self, words: list[bytes], start: int, base: int, spans: list[list[int]], items: set[int]) -> None:
        """Occurrences whose last word is at ``start`` or later. ``spans`` gets them as runs of word numbers (from ``base``),
        overlapping and touching ones joined; ``items`` the items that own them."""
        m, far, get, buckets, pair = self.length, self.far, self.shift.get, self.buckets, self.block == 2
        i, n = max(m - 1, start), len(words)
        while i < n:
            block = (words[i - 1], words[i]) if pair else (words[i],)
            s = get(block, far)
            if s:
                i += s
                continue
            i += 1
            owners = buckets[block].get(tuple(words[i - m:i]))
            if owners:
                items.update(owners)
                if spans and spans[-1][1] >= base + i - m:
                    spans[-1][1] = base + i
                else:
                    spans.append([base + i - m, base + i])


def build(items: list[tuple[int, list[bytes]]], window: int) -> list[Patterns]:
    """Search tables by pattern length, of numbered items as word lists."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for number, words in items:
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set()).add(number)
    return [Patterns(m, {w: tuple(o) for w, o in found.items()}) for m, found in sorted(by_length.items())]


def find(raw: bytes, tables: list[Patterns]) -> tuple[int, list[list[int]], set[int]]:
    """Of one text: its number of words, the hit runs ``[start, end)`` of word numbers in order, the items that occur."""
    longest = max((t.length for t in tables), default=1)
    per_table: list[list[list[int]]] = [[] for _ in tables]
    items: set[int] = set()
    n, tail = 0, []
    for piece in pieces(raw.translate(_TO_WORDS)):
        words = tail + piece.split()
        for t, spans in zip(tables, per_table):
            t.search(words, len(tail), n - len(tail), spans, items)
        n += len(words) - len(tail)
        tail = words[max(0, len(words) - longest + 1):]
    return n, _joined(per_table), items


def _joined(per_table: list[list[list[int]]]) -> list[list[int]]:
    if len(per_table) == 1:
        return per_table[0]
    out: list[list[int]] = []
    for a, b in sorted(s for spans in per_table for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' names and words in blocks of about ``block_words`` words; one block at a time is on the driver."""
    block, size = [], 0
    for name, raw in items.toLocalIterator():
        words = words_of(bytes(raw))
        step = max(1, block_words - window + 1)
        for a in range(0, max(1, len(words) - window + 1), step):
            part = words[a:a + step + window - 1] if len(words) > window else words
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((name, part))
            size += len(part)
    yield block


def _scan(block: list[tuple[str, list[bytes]]], window: int, columns: list[str], every_row: bool) -> Callable:
    """An Arrow function: the columns as they come, without the text (the last), and what :func:`find` finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build([(i, words) for i, (_, words) in enumerate(block)], window)
        for batch in batches:
            text, found = batch.column(batch.num_columns - 1), []
            for k in range(batch.num_rows):
                n, spans, items = find(text[k].as_py(), tables)
                if every_row or spans:
                    found.append((k, n, [{"start": a, "end": b} for a, b in spans], sorted({block[i][0] for i in items})))
            rows = pa.array([f[0] for f in found], pa.int32())
            kept = [batch.column(i).take(rows) for i in range(len(columns))]
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(span)),
                 pa.array([f[3] for f in found], pa.list_(pa.string()))], names=[*columns, "n_words", "spans", "items"])
    return run


def contaminated_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = 10, block_words: int = 200_000) -> DataFrame:
    """``(id_col, n_words, spans, items)`` of every row of ``docs``: its number of words, the runs ``[start, end)`` of words
    inside occurrences of windows of ``items`` (joined, in order), and the ids of those items as strings, sorted.

    Null texts have no words, and texts without words neither windows nor hits; an empty table of items hits nothing, an empty
    table of documents gives an empty result. Rows with equal ids or texts are judged row by row. Items with the same id count
    once; a null item id has the empty string as name. Other columns, whatever their names, are not looked at."""
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"),
                         text_or_empty(F.col(item_text_col)).cast("binary").alias("raw"))
    raw = text_or_empty(F.col(text_col)).cast("binary")
    blocks = _blocks(named, window, block_words)
    block, following = next(blocks), next(blocks, None)
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"n_words long, spans {SPAN}, items array<string>"
    if following is None:
        src = docs.select(F.col(id_col).alias("id"), raw.alias("t"))
        return src.mapInArrow(_scan(block, window, ["id"], True), f"id {kind}, {out}").withColumnRenamed("id", id_col)
    # several blocks: a row is known by its id and its text's digest; equal rows have equal results
    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(raw, 256)).alias("h"), raw.alias("t"))
    schema = f"id {kind}, h binary, {out}"
    base = src.mapInArrow(_scan(block, window, ["id", "h"], True), schema)
    found = base.where(F.size("spans") > 0)
    while following is not None:
        found = found.unionByName(src.mapInArrow(_scan(following, window, ["id", "h"], False), schema))
        following = next(blocks, None)
    merged = found.distinct().groupBy("id", "h").agg(F.flatten(F.collect_set("spans")).alias("_s"),
                                                     F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_i"))
    b, m = base.alias("b"), merged.alias("m")
    both = b.join(m, F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.h") == F.col("m.h")), "left")
    return both.select(F.col("b.id").alias(id_col), F.col("b.n_words"), _union_of(F.coalesce("m._s", "b.spans")).alias("spans"),
                       F.coalesce("m._i", "b.items").alias("items"))


def _union_of(spans: Column) -> Column:
    """Runs joined where they overlap or touch."""
    def union(found: list) -> list[tuple[int, int]]:
        return [(a, b) for a, b in _joined([[[s["start"], s["end"]] for s in found], []])]
    return F.udf(union, SPAN, useArrow=True)(spans)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items, contaminated)`` of every row: words, words inside occurrences, the items that
    occur, and whether any does; nulls, empty tables and repeated rows as in :func:`contaminated_spans`."""
    found = contaminated_spans(docs, items, id_col, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
                        (F.size("spans") > 0).alias("contaminated"))
