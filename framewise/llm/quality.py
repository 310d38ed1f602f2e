"""Quality classifier by importance resampling.

Two hashed n-gram models generate text: the *raw* model counts the n-grams of all documents, the *target* model
those of documents labelled good. A document's importance weight is the mean log ratio of the two over its
n-grams (``log_weight``). N-grams are the 2, 3 and 4-byte strings plus, for every pair of neighbouring words, how
often the document has repeated that pair (as a power of two): a text may repeat itself in perfectly ordinary
letters. The documents that stay are a Gumbel top-k sample: weight over temperature plus Gumbel noise from a hash
of the id, the k largest win; k is the number of documents whose weight is at or above the cut, the weight that
parts the documents labelled good from those labelled bad best.

Counts and weights cover every byte of every document; only the labels are a bounded sample (``max_labels``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import own_name, text_or_empty
from framewise.session import cut_lineage

BUCKET_BITS, SIZES, CHUNK = 16, (2, 3, 4), 1 << 20
BUCKETS = 1 << BUCKET_BITS
_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio, odd: multiplicative hashing
_SHIFT = np.uint64(64 - BUCKET_BITS)


def _hashed(codes: np.ndarray, kind: int) -> np.ndarray:
    return (((codes ^ np.uint64(kind << 56)) * _ODD) >> _SHIFT).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(0x100000001B3, 4096), _powers(pow(0x100000001B3, -1, 1 << 64), 4096)


def _word_hashes(b: np.ndarray) -> np.ndarray:
    """One 64-bit polynomial hash per word (run of bytes that are not white space)."""
    global _POW, _INV
    solid = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(_POW) <= len(b):
        n = 1 << len(b).bit_length()
        _POW, _INV = _powers(0x100000001B3, n), _powers(pow(0x100000001B3, -1, 1 << 64), n)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POW[:len(b)])))
    return (sums[ends] - sums[starts]) * _INV[starts]


def features(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, in pieces of bounded size."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(b), CHUNK):
        wide = b[at:at + CHUNK + SIZES[-1] - 1].astype(np.uint64)
        for n in SIZES:
            m = min(CHUNK, len(wide) - n + 1)  # n-grams that start in this chunk
            if m > 0:
                codes = wide[:m].copy()
                for i in range(1, n):
                    codes = codes << np.uint64(8) | wide[i:m + i]
                yield _hashed(codes, n)
    words = _word_hashes(b)
    if len(words) > 1:
        pairs = words[:-1] * np.uint64(3) + words[1:]
        _, which, times = np.unique(pairs, return_inverse=True, return_counts=True)
        yield _hashed(np.log2(times).astype(np.uint64)[which], 1)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labels: int) -> DataFrame:
    """``docs`` plus a 0/1/null column: the labels of a hash sample of at most ``max_labels`` labelled ids. Ids with
    both labels count as 0. The sample is small by its bound, so it is broadcast."""
    name = own_name(docs, "label")
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).cast("int").alias(name))
    sample = cut_lineage(lab.orderBy(F.xxhash64("_id"), "_id").limit(max_labels))
    return docs.join(F.broadcast(sample), docs[id_col] == sample["_id"], "left").select(*[docs[c] for c in docs.columns], name)


def fit(docs: DataFrame, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of target to raw model per bucket, and the target counts (one of each unseen). All documents are
    counted; the driver gets one row per bucket (2^16)."""
    src = docs.select(text_or_empty(F.col(text_col)).alias("t"), F.coalesce(F.col(label_col) == 1, F.lit(False)).alias("good"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {False: np.zeros(BUCKETS, np.int64), True: np.zeros(BUCKETS, np.int64)}
        held: dict[bool, list] = {False: [], True: []}
        waiting = 0
        for b in batches:
            for t, good in zip(b["t"], b["good"]):
                for f in features(t):
                    held[bool(good)].append(f)
                    waiting += len(f)
                if waiting > CHUNK:
                    waiting = 0
                    _add(sums, held)
        _add(sums, held)
        raw = sums[False] + sums[True]
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "raw": raw[at], "target": sums[True][at]})

    counts = src.mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)  # one of each unseen
    raw[counts["bucket"]] += counts["raw"].to_numpy(float)
    target[counts["bucket"]] += counts["target"].to_numpy(float)
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), target


def _add(sums: dict, held: dict) -> None:
    for k, fs in held.items():
        if fs:
            sums[k] += np.bincount(np.concatenate(fs), minlength=BUCKETS)
            fs.clear()


def _scorer(docs: DataFrame, table: np.ndarray, target: np.ndarray | None = None):
    """Column function of (text, good): n-grams, their summed log ratios, and (``apart``) the same sum with a good
    text's own n-grams taken out of the ``target`` counts, which is how a text without a label is seen."""
    shared = docs.sparkSession.sparkContext.broadcast((table.astype(np.float32), target))

    @F.pandas_udf("n long, total double, apart double")
    def score(t: pd.Series, good: pd.Series) -> pd.DataFrame:
        ratio, counts = shared.value
        all_counts = 0.0 if counts is None else counts.sum()
        rows = []
        for x, g in zip(t, good):
            n, total, own = 0, 0.0, np.zeros(BUCKETS, np.int64) if g else None
            for f in features(x):
                n, total = n + len(f), total + float(ratio[f].sum(dtype=np.float64))
                if g:
                    own += np.bincount(f, minlength=BUCKETS)
            apart = total
            if g:
                at = np.flatnonzero(own)
                left = np.maximum(counts[at] - own[at], 1)
                apart += float(own[at] @ np.log(left / counts[at])) - n * math.log(max(all_counts - n, 1) / all_counts)
            rows.append((n, total, apart))
        return pd.DataFrame(rows, columns=["n", "total", "apart"])

    return score


def _best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that maximises the kept share of the good less the kept share of the others; of equals the lowest.
    Labels that are wrong at random scale that difference for every cut alike, so they don't move its maximum."""
    values, at = np.unique(weights, return_inverse=True)
    below = [np.concatenate(([0], np.cumsum(np.bincount(at[k], minlength=len(values)))[:-1])) / k.sum() for k in (good, ~good)]
    return float(values[np.argmax(below[1] - below[0])])


class QualityModel:
    """A fitted classifier: the bucket table, the prior that short texts are drawn to, the cut and the Gumbel
    threshold. ``score`` adds ``log_weight``, ``gumbel_score`` and ``kept`` to any documents."""

    def __init__(self, table: np.ndarray, prior: float, pseudo: float, cut: float, temperature: float, seed: int, threshold: float):
        self.table, self.prior, self.pseudo, self.cut = table, prior, pseudo, cut
        self.temperature, self.seed, self.threshold = temperature, seed, threshold

    def columns(self, n: Column, total: Column, doc_id: Column) -> tuple[Column, Column]:
        weight = (total + self.prior * self.pseudo) / (n + self.pseudo)
        u = (F.xxhash64(F.lit(self.seed), doc_id).cast("double") + (2.0 ** 63 + 0.5)) / 2.0 ** 64
        noise = -F.log(-F.log(F.greatest(F.least(u, F.lit(1 - 1e-12)), F.lit(1e-300))))
        return weight, (weight - self.cut) * (n + self.pseudo) / self.temperature + noise

    def score(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        s = own_name(docs, "scored")
        d = docs.withColumn(s, _scorer(docs, self.table)(text_or_empty(F.col(text_col)), F.lit(False)))
        weight, gumbel = self.columns(F.col(f"{s}.n"), F.col(f"{s}.total"), F.col(id_col))
        names = [own_name(docs, c) for c in ("log_weight", "gumbel_score", "kept")]
        return d.select(*[d[c] for c in docs.columns], weight.alias(names[0]), gumbel.alias(names[1])).withColumn(
            names[2], F.col(names[1]) >= self.threshold)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labels: int = 20_000, lose: float = 0.0005, pseudo: float = 300.0, temperature: float = 0.05,
          seed: int = 42, carry: bool = False) -> tuple[QualityModel, DataFrame]:
    """The model and the checkpointed scores ``(id, label, n, total, apart)`` of all rows; with ``carry`` also ``row``, the
    whole row, so that it need not be scored again.

    ``cut``: the weight at which the kept share of the labelled good documents exceeds that of the labelled bad ones
    most, good ones weighed without their own counts. Only if no document is labelled bad, it is the weight below which
    the share ``lose`` of the good ones lies. ``pseudo`` n-grams of the good documents' mean weight are added to every
    text, so short texts need more than one odd word to go; null and empty texts have only those. Without a good label
    every document has weight 0 and stays. Rows with the same id share their noise; rows that tie at the k-th place
    stay together. Same input, same result.
    """
    lab = _labelled(docs if carry else docs.select(id_col, text_col), labels, id_col, label_col, max_labels)
    label = lab.columns[-1]
    whole = [F.struct(*[lab[c] for c in docs.columns]).alias("row")] if carry else []
    table, target = fit(lab, text_col, label)
    score = _scorer(lab, table, target)(text_or_empty(F.col(text_col)), F.coalesce(F.col(label) == 1, F.lit(False)))
    s = own_name(lab, "s")
    scored = cut_lineage(lab.withColumn(s, score).select(
        F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(f"{s}.n").alias("n"), F.col(f"{s}.total").alias("total"),
        F.col(f"{s}.apart").alias("apart"), *whole))
    sample = scored.select("id", "label", "n", "apart").where("label is not null and n > 0").orderBy(
        F.xxhash64("id"), "id").limit(max_labels).toPandas()
    is_good = (sample["label"] == 1).to_numpy(bool)
    if not is_good.any():
        return QualityModel(np.zeros(BUCKETS), 0.0, pseudo, 0.0, temperature, seed, -math.inf), scored
    prior = float((sample["apart"] / sample["n"])[is_good].mean())
    weights = ((sample["apart"] + prior * pseudo) / (sample["n"] + pseudo)).to_numpy(float)
    cut = float(np.quantile(weights, lose, method="lower")) if is_good.all() else _best_cut(weights, is_good)
    model = QualityModel(table, prior, pseudo, cut, temperature, seed, -math.inf)
    weight, gumbel = model.columns(F.col("n"), F.col("total"), F.col("id"))
    ranked = scored.select(weight.alias("w"), gumbel.alias("g"))
    k = ranked.where(F.col("w") >= cut).count()
    model.threshold = _kth_largest(ranked.select("g"), k)
    return model, scored


def _kth_largest(df: DataFrame, k: int) -> float:
    """A value v such that ``x >= v`` holds for the k largest values of the one column of ``df`` and those within
    2^-16 of the k-th. Values are cut to 48 bits of a fixed-point scale and found 16 bits at a time; the driver gets
    at most 2^16 counts per step."""
    if k <= 0:
        return math.inf
    x = F.col(df.columns[0])
    top = 2.0 ** 31 - 1
    q = (F.floor(F.greatest(F.least(x, F.lit(top)), F.lit(-top)) * 65536) + F.lit(1 << 47)).cast("long").alias("q")
    values = df.select(q)
    prefix = 0
    for shift in (32, 16, 0):
        part = values.where(F.shiftright("q", shift + 16) == prefix) if shift < 32 else values
        counts = part.groupBy(F.shiftright("q", shift).alias("p")).count().toPandas().sort_values("p", ascending=False)
        upto = counts["count"].cumsum().to_numpy()
        at = min(int(np.searchsorted(upto, k)), len(upto) - 1)
        k -= int(upto[at] - counts["count"].iloc[at])
        prefix = int(counts["p"].iloc[at])
    return (prefix - (1 << 47)) / 65536


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, log_weight, gumbel_score, kept)`` of every row, duplicates and null ids included."""
    model, scored = train(docs, labels, id_col, text_col, **options)
    weight, gumbel = model.columns(F.col("n"), F.col("total"), F.col("id"))
    return scored.select(F.col("id").alias(id_col), weight.alias("log_weight"), gumbel.alias("gumbel_score")).withColumn(
        "kept", F.col("gumbel_score") >= model.threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they are."""
    model, scored = train(docs, labels, id_col, text_col, carry=True, **options)
    _, gumbel = model.columns(F.col("n"), F.col("total"), F.col("id"))
    return scored.where(gumbel >= model.threshold).select("row.*")
