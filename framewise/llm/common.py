"""Helpers shared by the corpus operators: word counts, checkpoints, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.session import cut_lineage

# One word: a run of bytes that are neither space nor \t \n \v \f \r (the contracts' word pattern).
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def own_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def fits_broadcast(df: DataFrame, max_bytes: int = 8 << 20) -> bool:
    """Whether all rows of a checkpointed ``df`` take at most ``max_bytes`` (strings by length, others 16 bytes)."""
    width = F.lit(16 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
    return (df.agg(F.sum(width)).first()[0] or 0) <= max_bytes


def join_checked(big: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """``big.join(table)``: broadcast if the table's measured size is small, else a shuffled join that Spark
    splits where a key is hot."""
    return big.join(F.broadcast(table) if fits_broadcast(table) else table, on, how)


def cut_lineage_partitioned(df: DataFrame) -> DataFrame:
    """A checkpoint that keeps the hash partitioning of ``df``, so that later groupings by it need no shuffle. Adaptive
    execution hides the partitioning of what it ran, so it is off for this one job."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set(key, before)


EDGES_PER_FILE = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected graph given as ``(src, dst)`` longs: component is the smallest
    node reachable. Nodes without edges to other nodes do not appear.

    Alternating large-star and small-star rounds: every round joins each node's edges with its smallest
    neighbour (a partial aggregate, so a hub is combined before the shuffle, and an ordinary join, which
    Spark splits when one node has many edges) until the edge set stays the same, which is when every node
    points straight at the smallest one. Each round's edges are checkpointed, in as many files as their number asks for; the
    driver sees a count and a hash per round.
    """
    e = cut_lineage(edges.where(F.col("src") != F.col("dst"))
                    .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        e = e.coalesce(1 + state[0] // EDGES_PER_FILE)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"),
            F.col("u"), F.col("m"))
        e = cut_lineage(small.select(F.explode(F.array("a", "u")).alias("u"), F.col("m").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct().coalesce(1 + state[0] // EDGES_PER_FILE))
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def more_components(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp``, the components of some edges, with further ``edges`` taken in: only the components that these touch are
    worked on."""
    known = cut_lineage(comp)
    ends = edges
    for end in ("src", "dst"):
        at = known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
        ends = join_checked(ends, at, end, "left").withColumn(end, F.coalesce(f"{end}_c", end)).drop(f"{end}_c")
    over = cut_lineage(connected_components(ends))
    up = over.select(F.col("node").alias("component"), F.col("component").alias("root"))
    grown = join_checked(known, up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return grown.unionByName(over.join(known.select("node"), "node", "left_anti").select("node", "component"))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that long texts make short batches; a smaller setting of the session's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    size = int(now.rstrip("kmg")) * unit
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
