"""What op5's line deduplication computes per shingle, and that its report moves no text."""

import re

from pyspark.sql import functions as F

from framewise.llm import linededup


def _plain_signatures(lines, shingle):
    """One row per shingle, as the definition says."""
    code = F.encode("line", "UTF-16BE")
    cut = lines.select("id", code.alias("code"), F.explode(F.sequence(F.lit(0), F.greatest(
        F.octet_length(code) / 2 - shingle, F.lit(0)).cast("int"))).alias("at"))
    x = F.hash(F.substring("code", 2 * F.col("at") + 1, F.lit(2 * shingle)))
    return cut.groupBy("id").agg(*[F.min(x.bitwiseXOR(F.lit(c))) for c in linededup._constants()])


def test_signatures_take_every_shingle(spark):
    alphabet = "abc d\u00e9f\u4e2d\U0001f600gh"
    texts = ["".join(alphabet[(i * j + j * j) % len(alphabet)] for j in range(n)) for i, n in enumerate(range(1, 40))]
    lines = spark.createDataFrame(list(enumerate(texts + texts[-1:])), "id long, line string")
    got = {tuple(r) for r in linededup.signatures(lines, 8).collect()}
    assert got == {tuple(r) for r in _plain_signatures(lines, 8).collect()} and len(got) == 40


def test_signature_rows_hold_several_shingles(spark):
    lines = spark.createDataFrame([(1, "x" * 100)], "id long, line string")
    plan = linededup.signatures(lines, 8)._jdf.queryExecution().optimizedPlan().toString()
    hashes = re.findall(r"(?<![a-z0-9])hash\(", plan)
    assert len(hashes) == linededup.STEP > 1


def test_report_joins_without_texts(spark):
    docs = spark.createDataFrame([(1, "one line here\n \ntwo"), (2, "one line here"), (None, None), (3, ""), (3, "")],
                                 "doc_id long, text string")
    report = linededup.dedup_report(docs)
    above = report._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert not re.search(r"\btext#", above)
    rows = sorted(((r["doc_id"] or 0), r["n_lines"], r["n_removed"], r["kept_lines"]) for r in report.collect())
    assert rows == [(0, 0, 0, []), (1, 2, 0, [0, 2]), (2, 1, 1, []), (3, 0, 0, []), (3, 0, 0, [])]


def test_blank_lines(spark):
    lines = ["", " ", "\t\r\x0b\x0c ", " a ", "\u00a0", "\x00", " \t b", "c\t"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", linededup._blank(F.col("line")).alias("b"))
    assert [r["i"] for r in rows.orderBy("i").collect() if r["b"]] == [0, 1, 2]


def test_report_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a\nb\na")], "n_lines long, text_hash string")
    row = linededup.dedup_report(docs, "n_lines", "text_hash").first()
    assert list(row) == [1, 3, 1, [0, 1]]


def _shingle_sets(texts, shingle):
    return [{t[i:i + shingle] for i in range(max(len(t) - shingle, 0) + 1)} for t in texts]


def test_shingle_sets_and_parities(spark):
    alphabet = "abc déf中\U0001f600gh\n"
    texts = ["".join(alphabet[(i * j + j * j) % len(alphabet)] for j in range(n)) for i, n in enumerate(range(1, 60))]
    sets = _shingle_sets(texts, 8)
    text = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    got = {r["id"]: set(r["s"]) for r in text.select("id", linededup._shingles("line", 8).alias("s")).collect()}
    assert [len(got[i]) for i in range(len(texts))] == [len(s) for s in sets]
    for i in range(len(texts) - 1):
        assert len(got[i] & got[i + 1]) == len(sets[i] & sets[i + 1])
    for r in linededup._parities(text, 8).collect():
        words = [0] * linededup.WORDS
        for x in got[r["id"]]:
            words[x & (linededup.WORDS - 1)] ^= 1 << (x >> 8 & 63)
        assert r["size"] == len(sets[r["id"]]) and [w % (1 << 64) for w in r["odd"]] == words


def test_shingles_are_slices_and_parity_rows_hold_several(spark):
    text = spark.createDataFrame([(1, "x" * 100)], "id long, line string")
    plan = linededup._parities(text, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
    assert re.search(rf"explode\(sequence\(0, .*, Some\({linededup.STEP}\)", plan)


def test_report_splits_no_text_after_the_components(spark, tmp_path):
    docs = [(1, "one line here\n \ntwo"), (2, "one line here"), (None, None), (3, ""), (None, "two\n\nthree")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    report = linededup.dedup_report(spark.read.parquet(str(tmp_path / "d")))
    assert "parquet" not in report._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["kept_lines"]) for r in report.collect())
    assert rows == [(0, 0, 0, []), (0, 2, 1, [2]), (1, 2, 0, [0, 2]), (2, 1, 1, []), (3, 0, 0, [])]


def test_parity_words_are_judged_once_a_shingle(spark):
    text = spark.createDataFrame([(1, "x" * 100)], "id long, line string")
    plan = linededup._parities(text, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(rf"& {linededup.WORDS - 1}\b", plan)) == linededup.STEP
