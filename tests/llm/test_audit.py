"""The filter audit against a plain run of every order, and the document-term matrix against counted words."""

import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from framewise.llm import audit, queries
from framewise.session import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    first, out = {}, {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = defaultdict(list)
    for d, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > first.get(text, d)}
        rows[part or ""].append((d, {f for f in fails if fails[f]}))
    for part, own in rows.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return {(*k, *v) for k, v in out.items()}


def made(n=150):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(120)] + ["é", "日本", "WORD", "a|b", "#", "\x1c", "\xa0x"]
    docs = []
    for i in range(n):
        size = rng.choice([0, 1, 150, 199, 200, 201, 260])
        text = rng.choice([" ", "\n", "\t\v"]).join(rng.choices(pool[:rng.choice([120, 121, 127])], k=size))
        docs.append((rng.randrange(n), rng.choice([text, text, docs[-1][1] if docs else None]), rng.choice(["a", "a", "b", "", None])))
    docs += [(None, docs[0][1], "a"), (None, None, None), (7, "same", "b"), (7, "same", "b"), (9, "same", "c"), (5, "X" * 300_000, "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_against_every_order(spark):
    docs, labels = made()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    d = d.withColumns({c: F.lit(1) for c in ("h", "mask", "part", "shard", "id", "quality", "toxic", "n_words", "_text")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("good", "id", "part")})
    got = audit.audit(d, lab, shard_bytes=5000, bucket_bytes=3000).collect()
    assert len(got) == 600 * 4
    assert {tuple(r) for r in got} == brute(docs, labels)


def test_matrix_is_dense_and_exact(spark):
    docs, _ = made(60)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    m = audit.term_matrix(d, keep={"k": F.col("doc_id"), "t": F.col("text")}, shard_bytes=4000, bucket_bytes=2000)
    term = {r["column"]: r["term"] for r in m.terms.collect()}
    assert sorted(term) == list(range(m.n_columns)) and len(set(term.values())) == m.n_columns
    seen = 0
    shards = m.shards.collect()
    assert len(shards) > 4
    for s in shards:
        assert s["indptr"][0] == 0 and s["indptr"][-1] == len(s["indices"]) == len(s["data"])
        for r, a, b in zip(s["rows"], s["indptr"], s["indptr"][1:]):
            assert {term[c]: n for c, n in zip(s["indices"][a:b], s["data"][a:b])} == Counter(WORD.findall(r["t"] or ""))
            seen += 1
    assert seen == len(docs)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(d.limit(0), lab).count() == 0
    assert audit.audit(d, lab).count() == 600
    m = audit.term_matrix(d.limit(0))
    assert m.n_columns == 0 and m.shards.count() == 0 and m.terms.count() == 0


def test_registered_query(spark, sf):
    docs = [tuple(r) for r in read_table(spark, sf, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in read_table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    assert {tuple(r) for r in queries.op11_filter_audit(spark, sf).collect()} == brute(docs, labels)
