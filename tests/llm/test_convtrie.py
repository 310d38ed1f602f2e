"""The conversation trie against a dictionary of all prefixes, and double arrays against sets."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from framewise.llm import convtrie, queries
from framewise.llm.convtrie import DoubleArray
from framewise.session import read_table


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role.encode(), hashlib.sha256(text.encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        rebuilt[c] = tuple(base[:h] + own[c][h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()}


def made(seed, convs=60, hot=False):
    rng = random.Random(seed)
    pool = ["", "a", "b c", "d e f", None, "x " * 50]
    rows = []
    for c in rng.sample(range(-40, 400), convs):
        if hot and rng.random() < 0.6:
            texts = ["a", "b c", "a", "a", "d e f"][:rng.randrange(3, 6)] + rng.choices(pool, k=rng.randrange(2))
        else:
            texts = rng.choices(pool, k=rng.randrange(1, 9))
        rows += [(c, rng.choice([i, i, None]) if i < 2 else i, rng.choice(["u", "u", None]) if not hot else "u", t) for i, t in enumerate(texts)]
    rows += [(None, 1, "u", "a"), (7, 3, "u", "same"), (7, 3, "u", "same")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, hot, options", [
    (1, False, {}), (2, True, {"shard_turns": 3}), (3, True, {"segment": 3, "shard_turns": 4}), (4, False, {"segment": 1}),
    (5, True, {"segment": 2, "shard_turns": 1})])
def test_nodes_against_a_dictionary_of_prefixes(spark, seed, hot, options):
    rows = made(seed, hot=hot)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("c", "h", "w", "pos", "tid", "depth", "n")}).repartition(3)
    got = convtrie.prefix_trie(df, **options).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_long_conversation_and_many_copies(spark):
    rows = [(0, i, "u", f"t{i % 7}") for i in range(500)] + [(c, i, "u", f"t{i}") for c in range(20, 320) for i in range(3)]
    got = convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA), segment=64).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)
    assert convtrie.prefix_trie(df).count() == 0
    assert convtrie.prefix_trie(df.limit(0)).count() == 0


def test_double_array():
    rng = random.Random(9)
    for codes in (3, 50, 5000):
        paths = sorted({tuple(rng.randrange(codes) for _ in range(rng.randrange(6))) for _ in range(400)})
        trie = DoubleArray([list(p) for p in paths])
        prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
        assert len(trie.order) == len(prefixes) and len(set(trie.order)) == len(prefixes)
        slots = {}
        for p in prefixes:
            slot = 0
            for c in p:
                slot = trie.child(slot, c)
            slots[p] = slot
        assert sorted(slots.values()) == sorted(trie.order)
        for p in rng.sample(sorted(prefixes), min(60, len(prefixes))):
            for c in rng.sample(range(codes), min(codes, 40)):
                assert (trie.child(slots[p], c) >= 0) == (p + (c,) in prefixes)


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op12_conversation_trie(spark, sf).collect()} == brute(rows)
