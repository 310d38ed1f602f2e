"""Row-order operators without a row index, and without a one-task window.

pandas operators such as ``ffill``, ``pct_change``, ``rolling(20)`` and ``cumsum`` follow the implicit row order. Spark has
no row order, so every operator here takes explicit ``order_by`` columns of any orderable type (unique per partition key;
add a tie-breaker). A plain ``Window.orderBy`` would pull a whole key, or the whole table, into one task. Instead:

1. **ranges** - a sample of the full ``(partition_by..., order_by...)`` tuples is range-sorted, and the smallest tuple of
   each part becomes a bound. A row's bucket is the number of bounds not above its tuple (a binary search over the bounds,
   read as a scalar subquery), so a hot key, or a first order column with one value, is cut like anything else. Rows are
   shuffled once, by bucket, for the windows. The number of buckets follows the number of rows and has no ceiling;
2. **carry** - only the key of a bound can lie on both sides of it, so at most one key crosses each bucket edge. What it
   brings along is summed up per bucket from those rows alone (last value, total), scanned over the bounds of the same key
   as a tree on the executors (:func:`_scan`), and joined back by bucket;
3. **halo** - a window that looks ``k`` rows back gets copies of the ``k`` rows before its bucket. Only the order tuple and
   the columns the window reads are copied; per bucket at most ``k`` rows, found by a partial top-k before the exchange.

Small state only: bounds, carries and tail counts have one row per bucket (``ROWS_PER_BUCKET`` rows), whatever the number
of keys; their joins are broadcast if their measured size is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.columns import clean_value, join_sized, q, table_size
from framewise.session import cut_lineage

BUCKET = "_ob"
ROWS_PER_BUCKET = 1_000_000
ROWS_WORTH_A_BUCKET = 20_000  # below this a second bucket costs more than it saves
SAMPLED_PER_BUCKET = 64
SPAN = 1024  # rows of one window of the carry scan


@dataclass
class Ranges:
    """``rows`` with their bucket and whether their key is the lower (``_in``) or upper (``_out``) bound's, and so may come
    from the bucket before or go on into the next. ``bounds``: one row, the sorted array of the ``n`` bounds."""
    rows: DataFrame
    pb: list[str]
    ob: list[str]
    n: int = 0
    bounds: DataFrame | None = None
    flags: list[str] = field(default_factory=lambda: ["_in", "_out"])

    def edges(self) -> DataFrame:
        """``(_j, _seg)``: each bound's number from 1, and the first bound with the same key."""
        e = self.bounds.select(F.posexplode("_bounds").alias("_j", "_t")).withColumn("_j", F.col("_j") + 1)
        key = [F.col("_t")[f"_p{i}"] for i in range(len(self.pb))]
        return e.select("_j", F.min("_j").over(Window.partitionBy(*key)).alias("_seg") if key else F.lit(1).alias("_seg"))


def bucket_count(df: DataFrame, n_buckets: int | None, rows: int) -> int:
    if n_buckets:
        return n_buckets
    spread = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_WORTH_A_BUCKET))
    return max(1, spread, -(-rows // ROWS_PER_BUCKET))


def ranges(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
           n_buckets: int | None = None) -> Ranges:
    """Cut ``df`` into contiguous ranges of the full order tuple (nulls first, as Spark sorts)."""
    pb, ob = list(partition_by or []), list(order_by)
    rows = df.count()
    nb = bucket_count(df, n_buckets, rows)
    parts = {f"_p{i}": q(c) for i, c in enumerate(pb)} | {f"_o{i}": q(c) for i, c in enumerate(ob)}
    one = None
    if nb > 1 and rows:
        keys = df.select(*[c.alias(n) for n, c in parts.items()])
        share = SAMPLED_PER_BUCKET * nb / rows
        keys = keys if share >= 0.5 else keys.sample(share, 7)
        low = (keys.repartitionByRange(nb, *parts).select(F.spark_partition_id().alias("_part"), F.struct(*parts).alias("_t"))
               .groupBy("_part").agg(F.min("_t").alias("_t")))
        every = F.array_sort(F.collect_set("_t"))
        one = cut_lineage(low.agg(F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))).alias("_bounds")))
    n = one.select(F.size("_bounds")).first()[0] if one else 0
    if n < 1:
        return Ranges(df.withColumns({BUCKET: F.lit(0), "_in": F.lit(False), "_out": F.lit(False)}), pb, ob)
    d = df.withColumn("_bounds", one.scalar()).withColumn("_t", F.struct(*[c.alias(n) for n, c in parts.items()]))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    reach = lambda at, w: F.coalesce(F.get("_bounds", at + w - 1) <= F.col("_t"), F.lit(False))
    d = d.withColumn(BUCKET, F.aggregate(steps, F.lit(0), lambda at, w: F.when(reach(at, w), at + w).otherwise(at)))

    def same_key(bound: Column) -> Column:
        test = bound.isNotNull()
        for i in range(len(pb)):
            test = test & bound[f"_p{i}"].eqNullSafe(F.col("_t")[f"_p{i}"])
        return test
    d = d.withColumns({"_in": same_key(F.get("_bounds", F.col(BUCKET) - 1)), "_out": same_key(F.get("_bounds", F.col(BUCKET)))})
    return Ranges(d.drop("_bounds", "_t"), pb, ob, n, one)


def _scan(table: DataFrame, at: str, cols: dict[str, str], n: int, backward: bool) -> DataFrame:
    """Running total ("sum") or latest value ("last") of the columns along ``at`` within ``_seg``, the row itself included.

    A tree: windows of at most ``SPAN`` consecutive rows, the windows' results scanned in the same way, and put before them."""
    order = F.col(at).desc() if backward else F.col(at)

    def over(w, c, kind):
        return F.sum(c).over(w) if kind == "sum" else F.last(c, ignorenulls=True).over(w)
    g = f"{at}g"
    t = table.withColumn(g, F.floor(F.col(at) / F.lit(SPAN)).cast("int"))
    w = Window.partitionBy("_seg", g).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"_w{c}": over(w, c, k) for c, k in cols.items()})
    if n > SPAN:
        pick = F.min_by if backward else F.max_by
        whole = t.groupBy("_seg", g).agg(*[
            (F.sum(c) if k == "sum" else pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(at)))).alias(c) for c, k in cols.items()])
        whole = _scan(whole, g, cols, -(-n // SPAN), backward)
        before = whole.select("_seg", (F.col(g) + (-1 if backward else 1)).alias(g), *[F.col(c).alias(f"_b{c}") for c in cols])
        t = t.join(before, ["_seg", g], "left")
        t = t.withColumns({f"_w{c}": (F.coalesce(f"_w{c}", F.lit(0)) + F.coalesce(f"_b{c}", F.lit(0))) if k == "sum"
                           else F.coalesce(f"_w{c}", f"_b{c}") for c, k in cols.items()})
    return t.select("_seg", at, *[F.col(f"_w{c}").alias(c) for c in cols])


def _carried(r: Ranges, aggs: dict[str, Column], kinds: dict[str, str], backward: bool = False) -> DataFrame:
    """``r.rows`` with, per aggregate, what the earlier (``backward``: later) buckets hold of the row's key; null if nothing."""
    if not r.n:
        empty = r.rows.agg(*[a.alias(c) for c, a in aggs.items()]).schema
        return r.rows.withColumns({c: F.lit(None).cast(empty[c].dataType) for c in aggs})
    gives, takes, step = ("_in", "_out", -1) if backward else ("_out", "_in", 1)
    per = r.rows.where(gives).groupBy(BUCKET).agg(*[a.alias(c) for c, a in aggs.items()])
    edges = r.edges().withColumn(BUCKET, F.col("_j") if backward else F.col("_j") - 1)  # the bucket on the giving side
    carry = _scan(edges.join(per, BUCKET, "left"), BUCKET, kinds, r.n, backward)
    carry = cut_lineage(carry.select((F.col(BUCKET) + step).alias(BUCKET), F.lit(True).alias(takes), *aggs))
    return join_sized(r.rows, carry, [BUCKET, takes], table_size(carry), "left")


def local_window(pb: Sequence[str], order_by: Sequence[str]) -> Window:
    return Window.partitionBy(*[q(c) for c in pb], F.col(BUCKET)).orderBy(*[q(c) for c in order_by])


def _fill(df: DataFrame, order_by, partition_by, cols, n_buckets, forward: bool) -> DataFrame:
    r = ranges(df, order_by, partition_by, n_buckets)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in r.pb + r.ob]
    value = {f"_c{i}": clean_value(df, c) for i, c in enumerate(cols)}
    pick, when = (F.max_by if forward else F.min_by), F.struct(*[q(c) for c in r.ob])
    aggs = {n: pick(v, F.when(v.isNotNull(), when)) for n, v in value.items()}
    j = _carried(r, aggs, {n: "last" for n in aggs}, backward=not forward)
    # a frame "current row .. unbounded following" is recomputed per row by Spark (quadratic); the backward fill runs
    # forward over the reversed order
    ordering = [q(c) for c in r.ob] if forward else [q(c).desc_nulls_last() for c in r.ob]
    w = (Window.partitionBy(*[q(c) for c in r.pb], F.col(BUCKET)).orderBy(*ordering)
         .rowsBetween(Window.unboundedPreceding, 0))
    filled = {c: F.coalesce(F.last(v, ignorenulls=True).over(w), F.col(n)).cast(df.schema[c].dataType)
              for c, (n, v) in zip(cols, value.items())}
    return j.select(*[filled.get(c, q(c)).alias(c) for c in df.columns])


def ffill(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
          cols: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Forward fill every column along ``order_by``; leading nulls stay."""
    return _fill(df, order_by, partition_by, cols, n_buckets, forward=True)


def bfill(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
          cols: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Backward fill every column along ``order_by``; trailing nulls stay."""
    return _fill(df, order_by, partition_by, cols, n_buckets, forward=False)


def with_halo(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] | None, k: int,
              n_buckets: int | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """Bucketed rows plus, for each bucket, copies of the ``k`` rows of its first key that precede it (``_halo`` true), with the
    order tuple and the columns ``values`` (all, by default); their other columns are null. A window over
    :func:`local_window` that looks at most ``k`` rows back then sees what it would see over the whole key; drop the halo
    rows and ``BUCKET`` afterwards."""
    r = ranges(df, order_by, partition_by, n_buckets)
    d = r.rows.withColumn("_halo", F.lit(False))
    if k <= 0 or not r.n:
        return d.drop(*r.flags)
    kept = list(dict.fromkeys(r.pb + r.ob + list(df.columns if values is None else values)))
    latest = Window.partitionBy(BUCKET).orderBy(*[q(c).desc() for c in r.ob])
    tails = r.rows.where("_out").select(*[q(c) for c in kept], BUCKET, F.row_number().over(latest).alias("_back"))
    tails = cut_lineage(tails.where(F.col("_back") <= k))
    # how far back each bucket's tail lies from a later bucket: one count per bucket
    count = dict(tails.groupBy(BUCKET).count().collect())
    near = []
    for j, seg in r.edges().collect():
        gap, i = 0, j - 1
        while i >= seg - 1 and gap < k:
            if count.get(i):
                near.append((i, j, gap))
                gap += count[i]
            i -= 1
    if not near:
        return d.drop(*r.flags)
    to = df.sparkSession.createDataFrame(near, f"{BUCKET} int, _to int, _gap int")
    halo = join_sized(tails, to, [BUCKET], table_size(to)).where(F.col("_gap") + F.col("_back") <= k)
    halo = halo.select(*[q(c) for c in kept], F.col("_to").alias(BUCKET), F.lit(True).alias("_halo"))
    return d.drop(*r.flags).unionByName(halo, allowMissingColumns=True)


def lag_value(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
              k: int = 1, out: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """The value ``k`` rows earlier along ``order_by`` (null for the first ``k``)."""
    pb, ob = list(partition_by or []), list(order_by)
    d = with_halo(df, ob, pb, k, n_buckets, [col])
    r = d.withColumn(out or f"{col}_lag{k}", F.lag(clean_value(df, col), k).over(local_window(pb, ob)))
    return r.where(~F.col("_halo")).drop("_halo", BUCKET)


def rolling_mean(df: DataFrame, col: str, n: int, order_by: Sequence[str],
                 partition_by: Sequence[str] | None = None, out: str | None = None,
                 min_periods: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """Mean over the current and ``n - 1`` preceding rows; null until
    ``min_periods`` (default ``n``) non-null values are in the window."""
    pb, ob = list(partition_by or []), list(order_by)
    mp = n if min_periods is None else min_periods
    d = with_halo(df, ob, pb, n - 1, n_buckets, [col])
    w = local_window(pb, ob).rowsBetween(-(n - 1), 0)
    x = clean_value(df, col).cast("double")
    r = d.withColumn(out or f"{col}_sma{n}", F.when(F.count(x).over(w) >= mp, F.avg(x).over(w)))
    return r.where(~F.col("_halo")).drop("_halo", BUCKET)


def running_sum(df: DataFrame, col: str, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
                out: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """Cumulative sum along ``order_by``; nulls are skipped and stay null."""
    return running_sums(df, {col: out or f"{col}_cumsum"}, order_by, partition_by, n_buckets)


def running_sums(df: DataFrame, outs: dict[str, str], order_by: Sequence[str],
                 partition_by: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Several cumulative sums (``{column: output name}``) sharing one cut into ranges, one carry and one window pass."""
    r = ranges(df, order_by, partition_by, n_buckets)
    xs = {c: clean_value(df, c).cast("double") for c in outs}
    aggs = {f"_t{i}": F.sum(x) for i, x in enumerate(xs.values())}
    j = _carried(r, aggs, {t: "sum" for t in aggs})
    w = local_window(r.pb, r.ob).rowsBetween(Window.unboundedPreceding, 0)
    # like pandas' cumsum: a missing value keeps a missing total at its row
    j = j.withColumns({outs[c]: F.when(x.isNotNull(), F.sum(x).over(w) + F.coalesce(F.col(t), F.lit(0.0)))
                       for t, (c, x) in zip(aggs, xs.items())})
    return j.drop(BUCKET, *r.flags, *aggs)


def row_index(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] | None = None,
              out: str = "row_index", n_buckets: int | None = None) -> DataFrame:
    """0-based position along ``order_by`` (per partition key)."""
    r = ranges(df, order_by, partition_by, n_buckets)
    j = _carried(r, {"_t0": F.count(F.lit(1))}, {"_t0": "sum"})
    at = F.row_number().over(local_window(r.pb, r.ob)) - 1 + F.coalesce(F.col("_t0"), F.lit(0))
    return j.withColumn(out, at.cast("long")).drop("_t0", BUCKET, *r.flags)
