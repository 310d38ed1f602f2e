"""The numbered operators against brute force on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from framewise.llm import bpe, langid, lattice, linededup, mixing, quality, runindex, simhash, topk, urlfilter
from framewise.llm.common import connected_components, own_name
from framewise.session import read_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "   \n\t", "en", "a", 6), (3, "12 34", None, "b", 5),
       (4, "x" * 200_000, "en", "b", 200_000), (5, "one two", "en", None, 7), (5, "one two", "en", None, 7),
       (6, "one two", "en", "a", 7), (7, "é ü ñ 日本 <|endoftext|> 😀", "fr", "a", 20)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("size", "keep", "fp", "words", "host", "taken")})


def components(n, edges):
    par = list(range(n))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i
    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, i) for i in range(200, 230)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    want = components(300, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("distance, pairs_up_to", [(3, 64), (3, 2), (2, 2), (0, 64)])
def test_simhash_links_lose_nothing(spark, distance, pairs_up_to):
    rng = random.Random(distance * 100 + pairs_up_to)
    fps = set()
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            y = x
            for _ in range(rng.randrange(6)):
                y ^= 1 << rng.choice([rng.randrange(64), rng.randrange(8)])
            fps.add(y - (1 << 64) if y >= 1 << 63 else y)
    fps = sorted(fps)
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (2 ** 64 - 1)).count("1") <= distance]
    want = [fps[c] for c in components(len(fps), edges)]
    got = dict(connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance, pairs_up_to)).collect())
    assert [got.get(f, f) for f in fps] == want


def test_simhash_rows(spark, odd):
    rows = {(r["id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert (None, 0, 1) in rows and (2, 0, 1) in rows  # wordless texts are linked like any other
    same = {r for r in rows if r[0] in (5, 6)}
    assert {r[2] for r in same} == {5}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 7]
    assert simhash.fingerprint("A b\tC") == simhash.fingerprint("a b c") != simhash.fingerprint("a b d")
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    m = mixing.mix(odd)
    assert m.columns == odd.columns + ["size_", "source_size", "target", "taken_", "copies"]
    rows = m.collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        assert 0 <= r["taken_"] <= 2 * r["size_"]
        t = by.setdefault(r["source"], [r["source_size"], r["target"], 0])
        t[2] += r["taken_"]
    assert sum(t[0] for t in by.values()) == sum(r["size_"] for r in rows)
    assert all(t[1] <= 2 * t[0] and abs(t[1] - t[2]) <= 2 for t in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))
    assert mixing.draw(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(4)
    pool = [*map(chr, range(0x250)), *map(chr, range(0x2000, 0x2040)), "日", "😀", "<|endoftext|>", "'s", " the", "aaaa", "\n\n", "   "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(800)] + ["a" * 3000, " " * 500, "the" * 900]
    mine = bpe.ByteBpe(bpe.read_definition(path), keep=50)
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.digests(odd, path).collect()}
    for i, t, *_ in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd.limit(9), path), path)
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


def test_language_id(spark, sf, odd):
    docs = read_table(spark, sf, "documents")
    got = langid.identify(docs, langid.train(docs, per_lang=100)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and held
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"] for r in langid.identify(odd, langid.train(docs, per_lang=30)).collect() if r["lang_pred"] == "und"}
    assert und == {None, 1, 2, 3}
    assert langid.train(odd.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_line_dedup(spark, odd):
    rng = random.Random(3)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 25))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(7)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            lines.append("".join(x) if rng.random() < 0.9 else "  ")
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    lines = sorted({x for _, t in rows for x in t.split("\n") if x.strip()})
    sets = [{x[i:i + 8] for i in range(max(len(x) - 8, 0) + 1)} for x in lines]
    edges = []
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                edges.append((i, j))
    group = dict(zip(lines, components(len(lines), edges)))
    kept = linededup.drop_duplicate_lines(df).collect()
    got = [group[x] for r in kept for x in {(r["doc_id"], r["text"])} for x in x[1].split("\n") if x.strip()]
    twice = [group[x] for x in next(r["text"] for r in kept if r["doc_id"] == 3).split("\n") if x.strip()]
    assert sorted(got) == sorted([*set(group.values()), *twice])
    report = linededup.dedup_report(odd).collect()
    assert len(report) == len(ODD) and sum(r["n_lines"] - r["n_removed"] for r in report) == 5  # id 5 twice
    out = linededup.drop_duplicate_lines(odd)
    assert out.columns == odd.columns
    assert linededup.drop_duplicate_lines(odd.limit(0)).count() == 0


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "https://m.www.example.com/en/1", "x.com", None, "", "ftp://net/es/a",
            "http://b.net/es", "http://bnet/es/", "http://example.com", "http://com/", "a://b://c.com/", "http:///en/", "http://..com/a"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")

    def want(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        import re
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        host, path = m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *((max(fit)[1], max(fit)[2]) if fit else (None, "allow")))

    out = urlfilter.judge(df, rules)
    assert out.columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict"]
    got = [tuple(r)[3:] for r in sorted(out.collect())]
    assert got == [w for u in urls for w in (want(u), want(u))]
    assert urlfilter.judge(df, []).where("verdict <> 'allow'").count() == 0
    assert urlfilter.judge(df.limit(0), rules).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    c = urlfilter.Cascade(keys)
    df, words = c.attach(keys, "w")
    assert len(c.levels) > 1
    assert df.where(c.contains(F.col("key"), words) != F.col("listed")).count() == 0


def test_topk(spark):
    rng = random.Random(8)
    codes = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(150)]
    codes += [(200 + i, codes[0][1]) for i in range(30)] + [(300 + i, codes[1][1] ^ (1 << i)) for i in range(20)] + [(None, 1), (900, None)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = {}
    for q, rank, i, d in topk.search(df, df.where("id % 50 = 0"), k=5).collect():
        got.setdefault(q, []).append((rank, d, i))
    ok = [(i, c) for i, c in codes if i is not None and c is not None]
    for q, c in ok:
        if q % 50 == 0:
            near = sorted((bin((c ^ x) & (2 ** 64 - 1)).count("1"), i) for i, x in ok if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(near)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_embedding_near_dedup(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 16))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(100 + i, [float(c) for c in x[0] + rng.normal(size=16) * 0.05]) for i in range(30)]
    rows += [(200, rows[5][1]), (201, [2 * c for c in rows[6][1]]), (300, None), (301, [0.0] * 16), (302, [None] + [1.0] * 15),
             (303, [float("nan")] * 16), (304, [1.0]), (305, [1.0]), (306, [1e308] * 16), (307, [1e-300] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids = [i for i, _ in rows]
    ok = {i: np.array(v, float) / np.abs(np.array(v, float)).max() for i, v in rows
          if v and None not in v and np.isfinite(v).all() and np.any(v)}
    edges = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9]
    want = components(1000, edges)
    for block in (2000, 8):  # one chunk per cell, and cells dealt out in chunk pairs
        got = {r["vec_id"]: r for r in lattice.near_duplicates(df, block=block).collect()}
        assert set(got) == set(ids)
        links = sum(r["n_links"] for r in got.values())
        assert 0.9 * 2 * len(edges) <= links <= 2 * len(edges)
        assert all(got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i in ids)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_e8_decoder():
    rng = np.random.default_rng(0)
    roots = lattice.neighbours()
    p = lattice.nearest_e8(rng.normal(size=(500, 8)) * 2)
    assert (lattice.nearest_e8(p) == p).all() and np.isin(p.sum(axis=1) % 2, [0.0]).all()
    x = rng.normal(size=(500, 8))
    p = lattice.nearest_e8(x)
    d = ((x - p) ** 2).sum(axis=1)
    for r in roots:
        assert (((x - p - r) ** 2).sum(axis=1) >= d - 1e-9).all()


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_passages(spark, hot):
    rng = random.Random(hot)
    words = ["th", "er", "on", "é", "ab ", "and ", ". ", "x", "\n"]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randrange(20, 120)) for _ in range(6)]
    rows = []
    for d in range(120):
        t = text(rng.randrange(120)) + "".join(rng.choice(passages) + text(rng.randrange(30)) for _ in range(rng.randrange(4)))
        if rng.random() < 0.1:
            t = rng.choice(["a", "ab"]) * rng.randrange(20, 300)
        rows.append((rng.choice([d, d, d // 2, None]), t))
    rows += [(5, None), (6, ""), (7, rows[3][1]), (1, rows[9][1]), (None, rows[9][1]), (400, "x" * 49), (401, "x" * 49), (402, "y" * 50), (403, "y" * 50)]
    last = runindex.LAST
    raw = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in raw:
        for i in range(len(b) - 49):
            first[b[i:i + 50]] = min(d, first.get(b[i:i + 50], last))
    want = []
    for (d0, _), (d, b) in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((d0, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(str, map(tuple, runindex.removal_report(df, hot=hot).collect()))) == sorted(map(str, want))
    assert runindex.removal_report(df.limit(0)).count() == 0


def test_quality(spark, sf, odd):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    lab = labels.collect()
    good = [got[r["doc_id"]] for r in lab if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in lab if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns
    assert quality.keep_good(odd, labels.limit(0)).count() == len(ODD)
    assert quality.keep_good(odd.limit(0), labels).count() == 0


def test_quality_wrong_labels(spark):
    """The cut holds with 2% of the labels flipped."""
    big = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, big, "documents"), read_table(spark, big, "labels")
    flipped = labels.withColumn("quality", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(50)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert flipped.join(labels.select("doc_id", F.col("quality").alias("q")), "doc_id").where("q <> quality and q = 0").count() >= 5
    kept = quality.classify(docs, flipped).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in kept.collect()}
    print("kept", kept)
    assert kept[1] >= 0.99 and kept[0] <= 0.05


def test_kth_largest(spark):
    x = [random.Random(1).uniform(-5, 5) for _ in range(500)] + [1e12, -1e12, 0.0, 0.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for k in (1, 2, 250, 504):
        assert abs(quality._kth_largest(df, k) - max(min(sorted(x)[-k], 2.0 ** 31 - 1), -2.0 ** 31 + 1)) <= 2 ** -15


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "bpe"]
    out = E.queries()["pipeline"](spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_names(spark):
    assert own_name(spark.createDataFrame([], "Fp int, fp_ int"), "fp") == "fp__"
