"""A trie over the turns of rebuilt conversations, in double arrays per prefix shard.

Turns. A conversation's rows are put in order of (turn, role, digest of the text) by ranges (no conversation is one task),
and distinct (role, text) pairs get dense numbers the same way. Each conversation is rebuilt from the first turns of a base
conversation and its own later ones.

Segments. A rebuilt conversation is cut every ``segment`` turns, so that no row grows with its length. A segment's root is
known by a 128-bit digest of all turns before it. The segments of one layer form tries under their roots; layers are worked
from the deepest up, and what a root's subtree holds goes to the node of the layer above that it continues.

Shards. Equal segments are combined first, so copies are one weighted path. A path belongs to the shard of its first ``cut``
turns: 2, and twice as many wherever more than ``shard_turns`` turns share such a prefix, as often as needed. A shard packs
its paths into one double array (:class:`DoubleArray`) over its own dense turn numbers, walks every path through BASE and
CHECK, and sums subtrees in reverse order of creation. Nodes at least ``cut`` turns deep are complete in their shard.
Shallower ones are shared by shards: their parts are merged globally by digest, and the shards' complete subtrees are added
to all their ancestors.

Members that end at a node are hashed in order of conv_id by streaming: range-sorted, rendered in chunks where they lie,
and only the chunks of a node come together, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import join_checked, text_or_empty, word_count
from framewise.plans.ordered import row_index
from framewise.session import cut_lineage

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie in two arrays: the child of slot s by code c is slot ``base[s] + c`` if ``check`` there says s. Slot 0 is the
    root; ``order`` lists the slots parents first."""

    def __init__(self, paths: list[list[int]]):
        """``paths``: sorted, distinct, of codes >= 0."""
        self.base, self.check, self.order = [0], [-2], [0]
        self._free = 1
        queue = [(0, 0, len(paths), 0)]
        for slot, lo, hi, depth in queue:  # the list grows while it is read
            while lo < hi and len(paths[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            codes, starts = [], []
            for k in range(lo, hi):
                code = paths[k][depth]
                if not codes or code != codes[-1]:
                    codes.append(code)
                    starts.append(k)
            self.base[slot] = base = self._place(codes)
            for code, a, b in zip(codes, starts, [*starts[1:], hi]):
                self._take(base + code, slot)
                queue.append((base + code, a, b, depth + 1))

    def _empty(self, slot: int) -> bool:
        return slot >= len(self.check) or self.check[slot] == -1

    def _place(self, codes: list[int]) -> int:
        """A base under which the slots of all codes are free: the first free slots are tried, else the end."""
        while not self._empty(self._free):
            self._free += 1
        slot = self._free
        for _ in range(64):
            while not self._empty(slot):
                slot += 1
            base = slot - codes[0]
            if len(codes) == 1 or all(self._empty(base + c) for c in codes):
                return base
            slot += 1
        return len(self.check) - codes[0]

    def _take(self, slot: int, parent: int) -> None:
        if slot >= len(self.check):
            more = slot + 1 - len(self.check)
            self.check.extend([-1] * more)
            self.base.extend([0] * more)
        self.check[slot] = parent
        self.order.append(slot)

    def child(self, slot: int, code: int) -> int:
        """The slot of the child, or -1."""
        t = self.base[slot] + code
        return t if 0 < t < len(self.check) and self.check[t] == slot else -1


def base_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its base: CRC-32 of its decimal id, modulo 4."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def rebuilt_turns(conversations: DataFrame, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(c, at, tid, w, length)`` of all turns of rebuilt conversations: place, dense number of (role, text), words, and the
    conversation's length; and ``(c, length)`` of every conversation. Rows without conv_id are left out."""
    src = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", text_or_empty(F.col("role")).alias("role"),
        F.unhex(F.sha2(text_or_empty(F.col("text")).cast("binary"), 256)).alias("h"), word_count(F.col("text")).alias("w"))
    src = cut_lineage(src)
    numbers = cut_lineage(row_index(src.groupBy("role", "h").agg(F.max("w").alias("w")), ["role", "h"], out="tid"))
    placed = row_index(src.drop("w"), ["turn", "role", "h"], ["c"], out="pos")
    turns = cut_lineage(join_checked(placed, numbers, ["role", "h"]).select("c", "pos", "tid", "w"))
    own = cut_lineage(turns.groupBy("c").agg((F.max("pos") + 1).alias("n")))
    base = own.select(F.col("c").alias("b"), F.col("n").alias("n_base"))
    meta = own.select("c", "n", (F.col("c") - F.col("c") % group).alias("b"), base_turns(F.col("c")).alias("skip")).join(base, "b", "left")
    taken = F.least(F.col("skip"), F.coalesce("n_base", F.lit(0)))
    meta = meta.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0)))
    meta = cut_lineage(meta.select("c", "b", "skip", "taken", "length"))
    later = join_checked(turns, meta.drop("b"), "c").where(F.col("pos") >= F.col("skip")).select(
        "c", (F.col("pos") - F.col("skip") + F.col("taken")).alias("at"), "tid", "w", "length")
    heads = turns.where(F.col("pos") < 3).withColumnRenamed("c", "b")  # a remainder of 4 asks for 3 turns at most
    first = meta.where("taken > 0").join(heads, "b").where(F.col("pos") < F.col("taken")).select(
        "c", F.col("pos").alias("at"), "tid", "w", "length")
    return first.unionByName(later), meta.select("c", "length")


def _segments(turns: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """``(layer, root, path, ids, words, next, c, ends)``: each conversation's pieces of ``segment`` turns, the last of which may
    be empty. ``root``, ``path`` and ``next`` are digests of the turns before, up to and after the piece."""
    layer = F.floor(F.col("at") / segment).cast("int").alias("layer")
    pieces = turns.groupBy("c", "length", layer).agg(F.array_sort(F.collect_list(F.struct("at", "tid", "w"))).alias("t"))
    whole = pieces.select("c", "length", "layer", F.col("t.tid").alias("ids"), F.col("t.w").alias("words"))
    none = F.array().cast("array<long>")
    rest = lengths.where(F.col("length") % segment == 0).select(
        "c", "length", F.floor(F.col("length") / segment).cast("int").alias("layer"), none.alias("ids"), none.alias("words"))
    s = whole.unionByName(rest)
    # the digests of the pieces, combined by XOR: each is a hash of the piece together with its place
    own = [F.xxhash64(F.lit(seed), "layer", "ids") for seed in (1, 2)]
    upto = Window.partitionBy("c").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({f"x{i}": F.bit_xor(h).over(upto) for i, h in enumerate(own)})
    before = [F.when(F.col("layer") == 0, F.lit(0)).otherwise(F.col(f"x{i}").bitwiseXOR(h)) for i, h in enumerate(own)]
    key = lambda *parts: F.unhex(F.md5(F.concat_ws(",", *[p.cast("string") for p in parts])))
    last = F.col("layer") == F.floor(F.col("length") / segment)
    content = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return s.select("layer", key(F.col("layer"), *before).alias("root"), key(F.col("layer"), *before, content).alias("path"), "ids", "words",
                    F.when(~last, key(F.col("layer") + 1, F.col("x0"), F.col("x1"))).alias("next"), "c", last.alias("ends"))


def _cuts(paths: DataFrame, shard_turns: int) -> DataFrame:
    """The paths with ``cut``: the length of the prefix by which they are dealt out."""
    paths, cut = paths.withColumn("cut", F.lit(2)), 2
    while True:
        prefix = F.slice("ids", 1, cut).alias("prefix")
        hot = paths.where(F.col("cut") == cut).groupBy("root", prefix).agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > shard_turns)
        hot = cut_lineage(hot.where(F.size("prefix") == cut).select("root", "prefix", F.lit(True).alias("hot")))
        if hot.isEmpty():
            return paths
        # at most one row per shard_turns turns of the table
        paths = paths.withColumn("prefix", prefix).join(F.broadcast(hot), ["root", "prefix"], "left")
        paths = cut_lineage(paths.withColumn("cut", F.when(F.col("hot"), 2 * cut).otherwise(F.col("cut"))).drop("prefix", "hot"))
        cut *= 2


NODE = ("upper boolean, complete boolean, key binary, up array<binary>, depth int, conv_id long, parent long, n long, w long, "
        "children long, leaves long, saved long, ends binary")
NAMES = [c.strip().split()[0] for c in NODE.split(",")]


def _shard_nodes(g: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard's trie. Those at or above a cut (``upper``) come with their digest and their ancestors', root
    first; ``children``, ``leaves`` and ``saved`` of those above it hold only what deeper layers brought."""
    values, codes = np.unique(np.concatenate([np.asarray(x, np.int64) for x in g["ids"]]), return_inverse=True)
    ends = np.cumsum([len(x) for x in g["ids"]]).tolist()
    codes, roots = codes.tolist(), {}
    symbols = [len(values) + roots.setdefault(bytes(r), len(roots)) for r in g["root"]]
    paths = [[s, *codes[a:b]] for s, a, b in zip(symbols, [0, *ends[:-1]], ends)]
    order = sorted(range(len(paths)), key=paths.__getitem__)
    trie = DoubleArray([paths[i] for i in order])
    size, root_of = len(trie.check), list(roots)
    n, words, depth, cut = ([0] * size for _ in range(4))
    conv, end, below, digest = ([None] * size for _ in range(4))
    for path, key, count, smallest, is_end, path_cut, w, x in zip(
            paths, g["path"], g["n"].tolist(), g["c"].tolist(), g["ends"], g["cut"].tolist(), g["words"], g["below"]):
        slot = 0
        for k, code in enumerate(path):
            parent, slot = slot, trie.child(slot, code)
            n[slot] += count
            if conv[slot] is None:
                conv[slot], depth[slot], cut[slot] = smallest, k, path_cut
                words[slot] = int(w[k - 1]) if k else 0
                if k <= path_cut:
                    digest[slot] = (hashlib.blake2b(digest[parent] + values[code].tobytes(), digest_size=16).digest() if k
                                    else root_of[code - len(values)])
            elif smallest < conv[slot]:
                conv[slot] = smallest
        if is_end:
            end[slot] = bytes(key)
        if x is not None:
            below[slot] = x
            end[slot] = None if x["ends"] is None else bytes(x["ends"])
    children, leaves, saved = ([0] * size for _ in range(3))
    rows = []
    for slot in reversed(trie.order[1:]):
        parent, d, x = trie.check[slot], depth[slot], below[slot] or {"children": 0, "leaves": 0, "saved": 0}
        complete = d >= cut[slot]
        children[slot] += x["children"]
        leaves[slot] = leaves[slot] + x["leaves"] if children[slot] else 1
        saved[slot] += x["saved"] + (n[slot] - 1) * words[slot]
        children[parent] += 1
        leaves[parent] += leaves[slot]
        saved[parent] += saved[slot]
        sums = (children[slot], leaves[slot], saved[slot]) if complete else (x["children"], x["leaves"], x["saved"])
        upper, up = d <= cut[slot], []
        if upper:
            at = parent
            while at:
                up.append(digest[at])
                at = trie.check[at]
        rows.append((upper, complete, digest[slot], up[::-1], d, conv[slot], None if upper else conv[parent], n[slot], words[slot],
                     *sums, end[slot]))
    return pd.DataFrame(rows, columns=NAMES).astype({"conv_id": "Int64", "parent": "Int64"})


DONE = ["conv_id", "depth", "parent", "n", "children", "leaves", "saved", "ends"]


def _layer_nodes(paths: DataFrame, shard_turns: int) -> tuple[DataFrame, DataFrame]:
    """A layer's nodes (``DONE``; depth counted from the roots, roots included), and its roots by ``key``."""
    total = paths.agg(F.sum(F.size("ids"))).first()[0] or 0
    spread = min(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 500)
    shards = max(1, spread, -(-total // shard_turns))
    shard = F.pmod(F.xxhash64("root", F.slice(F.col("ids"), F.lit(1), F.col("cut"))), F.lit(shards)).cast("int")
    found = cut_lineage(_cuts(paths, shard_turns).withColumn("shard", shard).groupBy("shard").applyInPandas(_shard_nodes, NODE))
    # shared nodes: their parts are summed; a complete one has a single part
    top = cut_lineage(found.where("upper").groupBy("key").agg(
        F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("complete", "up", "depth", "w", "children", "leaves", "saved", "ends")],
        F.min("conv_id").alias("conv_id")))
    kids = top.where("depth > 0").groupBy(F.element_at("up", -1).alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    own = top.join(kids, "key", "left").withColumn("children", F.when(F.col("complete"), F.col("children")).otherwise(
        F.col("children") + F.coalesce("kids", F.lit(0))))
    own = own.withColumns({
        "leaves": F.when(F.col("complete"), F.col("leaves")).when(F.col("children") == 0, 1).otherwise(F.col("leaves")),
        "saved": F.when(F.col("complete"), F.col("saved")).otherwise(F.col("saved") + (F.col("n") - 1) * F.col("w"))}).drop("kids")
    own = cut_lineage(own)
    under = (own.select(F.explode("up").alias("key"), "leaves", "saved").groupBy("key")
             .agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")))
    parents = own.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    whole = (own.withColumn("parent_key", F.try_element_at("up", F.lit(-1))).join(under, "key", "left").join(parents, "parent_key", "left")
             .withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}))
    whole = cut_lineage(whole.select("key", *DONE))
    return found.where("not upper").select(*DONE).unionByName(whole.select(*DONE)), whole.where("depth = 0")


def _member_digests(members: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """``(path, sha)``: SHA-256 of the ascending, comma-joined ids of each path. Ids are rendered where they lie after a range
    sort; a path's chunks then follow one another through one hash, never all in memory."""
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids, rows = None, [], []
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != path or 20 * len(ids) > chunk_bytes:
                    if ids:
                        rows.append((path, ids[0], ",".join(map(str, ids)).encode()))
                    path, ids = p, []
                ids.append(c)
            yield _table(rows, ("path", "first", "chunk"))
            rows = []
        if ids:
            yield _table([(path, ids[0], ",".join(map(str, ids)).encode())], ("path", "first", "chunk"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sha, rows = None, None, []
        for b in batches:
            for p, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if p == path:
                    sha.update(b",")
                else:
                    if sha:
                        rows.append((path, sha.hexdigest()))
                    path, sha = p, hashlib.sha256()
                sha.update(chunk)
            yield _table(rows, ("path", "sha"))
            rows = []
        if sha:
            yield _table([(path, sha.hexdigest())], ("path", "sha"))

    sorted_ids = members.repartitionByRange("path", "c").sortWithinPartitions("path", "c")
    chunks = sorted_ids.mapInArrow(render, "path binary, first long, chunk binary")
    return chunks.repartition("path").sortWithinPartitions("path", "first").mapInArrow(digest, "path binary, sha string")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kind = {"path": pa.binary(), "first": pa.int64(), "chunk": pa.binary(), "sha": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind[c]) for i, c in enumerate(names)], names=list(names))


def prefix_trie(conversations: DataFrame, group: int = 20, segment: int = 4096, shard_turns: int = 200_000) -> DataFrame:
    """A row per distinct prefix of rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the
    parent's; null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens``
    (over the subtree: members but one, times the words of the node's last text), ``ends_sha256`` (members of exactly this
    length, ascending, comma-joined).

    Turns are in order of turn (null first), equal ones by role and the digest of the text, repeated rows each a turn. Null
    roles and texts are empty; rows with a null conv_id are left out; an empty table has no nodes, not even a root. A
    conversation whose base is absent and which has no later turn is a member of the root alone. Extra columns are not read."""
    turns, lengths = rebuilt_turns(conversations, group)
    pieces = cut_lineage(_segments(turns, lengths, segment))
    paths = cut_lineage(pieces.groupBy("layer", "root", "path", "ids", "words", "next").agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.max("ends").alias("ends")))
    deepest = paths.agg(F.max("layer")).first()[0]
    none = F.lit(None).cast("struct<children:bigint,leaves:bigint,saved:bigint,ends:binary>")
    nodes, roots = None, None
    for layer in range(-1 if deepest is None else deepest, -1, -1):
        own = paths.where(F.col("layer") == layer)
        if roots is None:
            own = own.withColumn("below", none)
        else:
            # a root without children is a leaf of its own, which the node above it counts
            left = F.when(F.col("children") > 0, F.col("leaves")).otherwise(0).cast("long")
            own = own.join(roots.select(F.col("key").alias("next"), F.struct("children", left.alias("leaves"), "saved", "ends").alias("below")), "next", "left")
        found, roots = _layer_nodes(own, shard_turns)
        found = found.where("depth > 0").withColumn("depth", F.col("depth") + layer * segment) if layer else found
        nodes = found if nodes is None else nodes.unionByName(found)
    if nodes is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                                          "n_leaves long, saved_tokens long, ends_sha256 string")
    digests = _member_digests(pieces.where("ends").select("path", "c"))
    out = nodes.join(digests.withColumnRenamed("path", "ends"), "ends", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
