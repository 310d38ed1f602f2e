"""The pipeline's stages on a small corpus, each against a plain computation over its own input."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as P
from framewise.llm import quality
from framewise.session import read_table

MASK = (1 << 64) - 1


def grams(text):
    """Bucket counts of a text's byte n-grams and of how often its word pairs come back, one by one."""
    raw, out = text.encode(), Counter()

    def add(code, kind):
        out[((code ^ (kind << 56)) * 0x9E3779B97F4A7C15 & MASK) >> 48] += 1
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            add(int.from_bytes(raw[i:i + n], "big"), n)
    words = raw.split()
    pairs = Counter(zip(words, words[1:]))
    for times in pairs.values():
        for _ in range(times):
            add(times.bit_length() - 1, 1)
    return out


def weights(docs, labels, pseudo=300.0):
    """Per id: the importance weight, and the cut, from the models' definition."""
    counts = {d: grams(t or "") for d, t in docs}
    raw, target = np.ones(1 << 16), np.ones(1 << 16)
    for d, c in counts.items():
        for b, k in c.items():
            raw[b] += k
            target[b] += k * (labels.get(d) == 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    n = {d: sum(c.values()) for d, c in counts.items()}
    total = {d: sum(k * ratio[b] for b, k in c.items()) for d, c in counts.items()}
    apart = dict(total)
    for d, c in counts.items():
        if labels.get(d) == 1:  # as a text without a label is seen
            apart[d] += sum(k * math.log(max(target[b] - k, 1) / target[b]) for b, k in c.items()) - n[d] * math.log((target.sum() - n[d]) / target.sum())
    good = [d for d in counts if labels.get(d) == 1 and n[d]]
    bad = [d for d in counts if labels.get(d) == 0 and n[d]]
    prior = np.mean([apart[d] / n[d] for d in good])
    seen = {d: (apart[d] + prior * pseudo) / (n[d] + pseudo) for d in good + bad}
    best = max((sum(seen[d] >= c for d in good) / len(good) - sum(seen[d] >= c for d in bad) / len(bad), -c) for c in seen.values())
    return {d: (total[d] + prior * pseudo) / (n[d] + pseudo) for d in counts}, -best[1]


def fingerprint(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """name -> (the stage's input, its output), as (doc_id, text, ...) rows."""
    base, docs, out = tmp_path_factory.mktemp("stages"), read_table(spark, sf, "documents"), {}
    for name, stage in P.STAGES:
        done = stage(spark, docs, sf)
        done.write.parquet(f"{base}/{name}")
        done = spark.read.parquet(f"{base}/{name}")
        if name != P.STAGES[-1][0]:
            assert done.columns == docs.columns
        out[name] = docs.collect(), done.collect()
        docs = done
    return out


def test_quality_stage_keeps_what_is_at_or_above_the_cut(spark, sf, stages):
    before, after = stages["quality"]
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}
    weight, cut = weights([(r["doc_id"], r["text"]) for r in before], labels)
    got = {r["doc_id"]: r for r in quality.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels")).collect()}
    assert all(abs(got[d]["log_weight"] - w) < 1e-4 for d, w in weight.items())
    kept = {r["doc_id"] for r in after}
    assert 0 < len(kept) < len(before)
    assert all((d in kept) == (w >= cut) for d, w in weight.items() if abs(w - cut) > 5e-3)
    assert {r for r in after} <= {r for r in before}  # whole rows, as they were


def test_line_stage_removes_lines_only(stages):
    before, after = stages["line_dedup"]
    assert [r["doc_id"] for r in sorted(before, key=lambda r: r["doc_id"])] == [r["doc_id"] for r in sorted(after, key=lambda r: r["doc_id"])]
    now = {r["doc_id"]: r for r in after}
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        lines, left = (r["text"] or "").split("\n"), (now[r["doc_id"]]["text"] or "").split("\n")
        at = iter(lines)
        assert left == [""] or all(x in at for x in left)  # the lines that stay are in their order
        for x in lines:
            if x.strip(" \t\r\x0b\x0c"):
                first.setdefault(x, r["doc_id"])
        assert now[r["doc_id"]]["n_chars"] == len(now[r["doc_id"]]["text"] or "")
    texts = {d: (r["text"] or "").split("\n") for d, r in now.items()}
    once = Counter(x for lines in texts.values() for x in lines if x.strip(" \t\r\x0b\x0c"))
    assert max(once.values()) == 1 and set(once) <= set(first)  # no line is there twice


def test_simhash_stage_keeps_one_document_of_each_group(stages):
    before, after = stages["simhash"]
    fp = {r["doc_id"]: fingerprint(r["text"]) for r in before}
    ids, group = sorted(fp), {d: d for d in fp}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert sorted(r["doc_id"] for r in after) == [d for d in ids if find(d) == d]


def test_mixing_stage_comes_near_the_targets(stages):
    before, after = stages["mixing"]
    size = lambda rows: Counter({s: sum(len((r["text"] or "").encode().split()) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    had, has = size(before), size(after)
    names = sorted(had, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(had.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * had[s]}
        for s in over or free:
            target[s] = 2 * had[s] if over else share[s]
            left -= target[s]
        free = free - over if over else set()
    longest = {s: max(len((r["text"] or "").split()) for r in before if r["source"] == s) for s in names}
    assert all(abs(has[s] - target[s]) <= longest[s] for s in names)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_bpe_stage_equals_the_library(stages):
    before, after = stages["bpe"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in after) == want
