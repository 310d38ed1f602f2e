"""Benchmark decontamination against a search of every window in every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framewise.llm import decontaminate, queries
from framewise.llm.textbytes import pieces
from framewise.session import read_table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add("" if name is None else str(name))
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = words(text)
        hit, own = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                found = windows.get(tuple(w[i:i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    own |= found
        out.append((d, len(w), len(hit), sorted(own, key=str.encode)))
    return sorted(out, key=str)


def made(seed, vocabulary=6):
    """Few words, so that windows repeat, overlap and touch; short items, empty ones, nulls and repeats among them."""
    rng = random.Random(seed)
    pool = ["Ab", "b", "é9", "日本", "x", "AB"][:vocabulary]

    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--", "\x7f", "\x00"]) for _ in range(n))
    items = [(i % 17, text(rng.choice([0, 1, 2, 3, 5, 10, 11, 14]))) for i in range(20)] + [(None, text(9)), (3, None), (4, "...")]
    docs = [(i % 25, text(rng.randrange(60))) for i in range(40)] + [(None, items[9][1]), (50, None), (51, ""), (52, " .,"), (52, " .,")]
    long = text(30000)
    return docs + [(60, long), (60, long), (61, "Z" * 3_000_000 + " b")], items


@pytest.mark.parametrize("seed, block_words", [(1, 200_000), (2, 200_000), (3, 40), (4, 13)])
def test_occurrences_against_brute_force(spark, seed, block_words):
    docs, items = made(seed, 6 if seed % 2 else 3)
    if seed == 2:
        items = [i for i in items if len(words(i[1])) != 1]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("t", "id", "h", "spans", "n_words", "name", "raw")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("name", "raw", "doc_id")})
    rows = decontaminate.report(d, i, block_words=block_words).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=str) == brute(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in rows)


def test_long_windows_skip_and_pieces_overlap(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(pool, k=40))) for i in range(30)]
    docs = []
    for d in range(30):
        w = rng.choices(pool, k=rng.choice([5, 300, 9000]))
        for _ in range(4):
            passage = words(items[rng.randrange(30)][1])
            a = rng.randrange(30)
            at = rng.randrange(len(w))
            w[at:at] = passage[a:a + rng.choice([8, 9, 10, 13])]
        docs.append((d, " ".join(w)))
    tables = decontaminate.build([(i, decontaminate.words_of(t.encode())) for i, t in items], 10)
    got = []
    for d, t in docs:
        n, spans, found = decontaminate.find(t.encode(), tables)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        got.append((d, n, sum(b - a for a, b in spans), sorted(map(str, found))))
    assert sorted(got, key=str) == brute(docs, items)


def test_pieces_lose_no_word():
    rng = random.Random(6)
    for _ in range(50):
        raw = b"".join(rng.choice([b"a", b"bb", b" ", b"\n\t", b"c" * 30]) for _ in range(200))
        cut = list(pieces(raw, rng.choice([1, 7, 40])))
        assert b"".join(cut) == raw and [w for p in cut for w in p.split()] == raw.split()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.report(docs.limit(0), items).count() == 0
    rows = decontaminate.report(docs, items.limit(0)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows) == [(1, 2, 0, []), (2, 0, 0, [])]


def test_registered_query(spark, sf):
    docs = [tuple(r) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read_table(spark, sf, "benchmark").select("item_id", "text").collect()]
    got = queries.op13_decontaminate(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    import hashlib
    want = {(d, n, h, len(o), hashlib.sha256(",".join(o).encode()).hexdigest(), h > 0) for d, n, h, o in brute(docs, items)}
    assert {tuple(r) for r in got.collect()} == want and any(w[-1] for w in want)
