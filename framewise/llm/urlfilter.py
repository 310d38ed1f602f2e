"""URL filter by a cascade of Bloom filters, with DataFrame functions only.

The keys of a url are its host and parent domains joined with the prefixes of its path that rules have. Over all keys
of the corpus (the complete key universe), level 1 encodes the listed keys; keys that are not listed but pass form
level 2; listed keys that pass level 2 form level 3; and so on until no key passes wrongly. A key's membership is then
exact: it is listed if the last level it passes in a row is odd. Testing needs no join: each level is one array of
words, read as a scalar subquery.

Size: level 1 takes about 1.44 log2(unlisted / listed) bits per listed key and each later level 1.44 bits per key that
still passes, at most the number of listed keys in expectation. So the cascade's size follows the list, which the
caller passes as an argument, not the corpus: a million rules in 100 billion keys take some 3 MB.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.llm.common import own_name
from framewise.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """The keys that rules of at most ``labels`` host labels and the given path lengths can match, longest first."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))),
                        lambda i: F.array_join(F.slice(parts, n - i + 1, i), "."))
    starts = F.filter(F.array(*[F.when(F.char_length(path) >= m, F.substring(path, 1, m)) for m in lengths]),
                      lambda p: p.isNotNull())
    keys = F.flatten(F.transform(F.filter(hosts, lambda h: h != ""), lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    return F.transform(F.sort_array(F.transform(F.array_distinct(keys), lambda k: F.struct(
        F.char_length(k).alias("n"), k.alias("key"))), asc=False), lambda s: s["key"])


class Level:
    """One Bloom filter: ``words`` is a checkpointed one-row frame with the array of 64-bit words."""

    def __init__(self, keys: DataFrame, number: int, bits_per_key: float, hashes: int):
        self.number, self.hashes = number, hashes
        n = keys.count()
        n_words = max(1, math.ceil(n * bits_per_key / 64))
        self.bits = 64 * n_words
        at = F.explode(F.array(*[self._position(F.col("key"), j) for j in range(hashes)]))
        words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        filled = keys.sparkSession.range(n_words).withColumnRenamed("id", "w").join(words, "w", "left").select(
            "w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        rows = filled.groupBy().agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("a"))
        self.words = cut_lineage(rows.select(F.transform("a", lambda s: s["bits"]).alias("words")))

    def _position(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits))

    def passes(self, key: Column, words: Column) -> Column:
        ok = F.lit(True)
        for j in range(self.hashes):
            at = self._position(key, j)
            ok = ok & (F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return ok


class Cascade:
    """Exact membership of the keys of a universe ``(key, listed)`` of distinct keys."""

    def __init__(self, universe: DataFrame):
        universe = cut_lineage(universe)
        n = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        listed, rest = n.get(True, 0), n.get(False, 0)
        rate = min(0.5, listed / rest) if rest else 0.5
        self.levels: list[Level] = []
        encode, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
        while listed:  # here: keys to encode at this level
            hashes = max(1, round(-math.log2(rate))) if not self.levels else 1
            bits = 1.44 * (max(1.0, -math.log2(rate)) if not self.levels else 1.0) + 0.1
            level = Level(encode, len(self.levels) + 1, bits, hashes)
            self.levels.append(level)
            w = own_name(other, "words")
            wrong = cut_lineage(other.withColumn(w, level.words.scalar()).where(level.passes(F.col("key"), F.col(w))).select("key"))
            encode, other, listed = wrong, encode, wrong.count()

    def attach(self, df: DataFrame, prefix: str) -> tuple[DataFrame, list[str]]:
        """``df`` with the levels' words as columns (scalar subqueries), for :meth:`contains`."""
        names = []
        for level in self.levels:
            names.append(own_name(df, f"{prefix}{level.number}"))
            df = df.withColumn(names[-1], level.words.scalar())
        return df, names

    def contains(self, key: Column, words: list[str]) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level, name in zip(reversed(self.levels), reversed(words)):
            answer = F.when(level.passes(key, F.col(name)), answer).otherwise(F.lit(level.number % 2 == 0))
        return answer


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("block", T.BooleanType())])
    return spark.createDataFrame([(host + path, verdict == "block") for verdict, host, path in rules], kind)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict`` (names with ``_`` appended if taken).

    ``rules``: (``allow`` or ``block``, host, path). A rule fits its host and all subdomains if the url's path starts
    with the rule's; the longest wins (host and path together; of equally long ones the later in code point order). No
    rule: null, and the cascade's answer for an unlisted key, ``allow``. A null url, or one without ``://``, has empty
    host and path and fits no rule. Repeated rows are judged alike; an empty table or no rules need no filter.
    """
    lengths = sorted({len(p) for _, _, p in rules})
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    host, path, rule, verdict, keys = (own_name(pages, c) for c in ("host", "path", "rule", "verdict", "url_keys"))
    d = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    if not rules:
        return d.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit("allow")})
    keyed = d.withColumn(keys, candidate_keys(F.col(host), F.col(path), labels, lengths))
    listed = F.broadcast(rules_frame(pages.sparkSession, rules))  # an argument of this call
    universe = cut_lineage(keyed.select(F.explode(keys).alias("key")).distinct().join(listed, "key", "left"))
    rule_keys = Cascade(universe.select("key", F.col("block").isNotNull().alias("listed")))
    blocked = Cascade(universe.where(F.col("block").isNotNull()).select("key", F.col("block").alias("listed")))
    keyed, in_rules = rule_keys.attach(keyed, "rule_words")
    keyed, in_blocked = blocked.attach(keyed, "block_words")
    found = F.get(F.filter(F.col(keys), lambda k: rule_keys.contains(k, in_rules)), F.lit(0))
    out = keyed.withColumn(rule, found)
    answer = F.when(F.col(rule).isNotNull() & blocked.contains(F.col(rule), in_blocked), "block").otherwise("allow")
    return out.withColumn(verdict, answer).select(*[F.col(c) for c in (*pages.columns, host, path, rule, verdict)])
