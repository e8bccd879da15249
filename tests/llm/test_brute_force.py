"""Operators that SQL can't express, against plain versions of what they compute."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def test_neighbours_over_several_shards(spark, monkeypatch):
    from quern.llm import neighbours

    monkeypatch.setattr(neighbours, "SHARD", 400)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    rows = [(i, x.tolist(), "other") for i, x in enumerate(v)]
    rows += [(2000, v[0].tolist(), "a"), (2000, v[1].tolist(), "b"), (2020, [1.0, 2.0], "short"), (2021, [2.0, 1.0], "short"), (2021, [2.0, 1.0], "again")]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    ids = {**{i: x for i, x in enumerate(v)}, 2000: min(v[0].tolist(), v[1].tolist())}
    keys, both = list(ids), np.array(list(ids.values()))
    hits = total = 0
    for q in [i for i in keys if i % 20 == 0]:
        scores = both @ np.array(ids[q])
        best = [i for _, i in sorted((-s, i) for s, i in zip(scores, keys, strict=True) if i != q)][:20]
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(np.dot(ids[r.vec_id], ids[q]))) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits, total = hits + len(set(best) & {r.vec_id for r in mine}), total + 20
    assert hits >= 0.9 * total
    assert [(r.vec_id, r.score) for r in by[2020]] == [(2021, 4.0)]


def test_a_search_visits_a_part_of_its_graph():
    from quern.llm.neighbours import beam_search, build

    rng = np.random.default_rng(1)
    v = rng.normal(size=(64, 24))[rng.integers(0, 64, 4000)] + 0.5 * rng.normal(size=(4000, 24))
    sq = (v * v).sum(1)
    x = np.c_[v, np.sqrt(sq.max() - sq)].astype(np.float32)
    graph, entry = build(x)
    q = v[:100]
    found, _, seen = beam_search(x, graph, np.c_[q, np.zeros(100)].astype(np.float32), entry, 64)
    score = q @ v.T
    best = np.argsort(-score, 1)[:, :20]
    kept = [set(f[np.argsort(-s[f])][:20]) for f, s in zip(found, score, strict=True)]
    assert np.mean([len(k & set(b)) / 20 for k, b in zip(kept, best, strict=True)]) >= 0.9
    assert seen < 0.5 * 100 * 4000


def plain_ctw(train: list[str], text: str, depth: int = 6) -> float:
    """log10 of the probability of a text under context trees, node by node."""
    lower = lambda s: bytes(b + 32 if 65 <= b <= 90 else b for b in s.encode())
    counts: dict = {}

    def walk(s: str):
        data = bytes(depth) + lower(s) + b"\0"
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[:i], (256 + data[i]) >> (8 - j), (data[i] >> (7 - j)) & 1

    for s in train:
        for before, node, bit in walk(s):
            for d in range(depth + 1):
                counts.setdefault((before[len(before) - d :], node), [0, 0])[bit] += 1
    lg = math.lgamma
    own = {k: lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1) for k, (a, b) in counts.items()}
    below: dict = {}
    both, weight = {}, {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        context, node = k
        if len(context) == depth:
            both[k], weight[k] = own[k], 1.0
        else:
            both[k] = np.logaddexp(own[k], below.get(k, 0.0)) - math.log(2)
            weight[k] = math.exp(own[k] - math.log(2) - both[k])
        if context:
            up = (context[1:], node)
            below[up] = below.get(up, 0.0) + both[k]
    total = 0.0
    for before, node, bit in walk(text):
        p = None
        for d in range(depth, -1, -1):
            k = (before[len(before) - d :], node)
            if k in counts:
                kt = (counts[k][bit] + 0.5) / (sum(counts[k]) + 1)
                w = 1.0 if p is None else weight[k]
                p = w * kt + (1 - w) * (p or 0.0)
        total += math.log10(0.5 if p is None else p)
    return total


def test_tree_scores_equal_a_plain_tree(spark):
    from quern.llm.ctw import HELD, lm_scores

    draw = random.Random(2)
    words = "the The cat sat on a mat and hat é 42".split()
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 9)))) for i in range(40)]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == HELD}
    train = [t for i, t in rows if i not in held]
    tokens = [w for t in train for w in [*(x.lower() for x in t.split()), None]]
    vocabulary = set(tokens)
    for i, t in rows:
        own = [*(x.lower() for x in t.split()), None]
        base = sum(math.log10((tokens.count(w) + 0.5) / (len(tokens) + 0.5 * (len(vocabulary) + 1))) for w in own)
        assert got[i].base_score == pytest.approx(base) and got[i].n_known == sum(w in vocabulary for w in own)
        assert (got[i].train_tokens, got[i].n_tokens, got[i].held_out) == (len(tokens), len(own), i in held)
        assert got[i].score == pytest.approx(plain_ctw(train, t), rel=1e-4, abs=1e-4)


def test_random_strings_are_found_and_identifiers_left(spark):
    from quern.llm.secrets import BASE, report, secret_spans

    draw = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ["".join(draw.choices(letters, k=32)) for _ in range(40)]
    names = ["getUserAccountByName", "parse_http_request_header2", "MaximumRetryCount10", "tableRowElementList"]
    rows = [(100_000 + i, f"the value {s} stands here") for i, s in enumerate(planted)] + [(200_000 + i, f"call {n} now") for i, n in enumerate(names)]
    rows.append((300_000, ("x password=abcdef1 y " * 3000) + "end"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r for r in report(secret_spans(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    assert sum(found[100_000 + i].spans == f"random:10:{10 + 32}" for i in range(40)) >= 36
    assert all(found[200_000 + i].spans == "" for i in range(len(names)))
    assert found[300_000].n_assign == 3000 and found[300_000].spans.endswith(f"assign:{2999 * 21 + 2}:{2999 * 21 + 18}")
    patterns = {k: (re.compile(p), g, n) for k, (p, g, n) in BASE.items()}
    for r in docs.collect():
        t = r.text or ""
        spans = sorted((m.start(), i, m.end()) for i, (p, g, n) in enumerate(patterns.values()) for m in p.finditer(t) if len(m.group(g)) >= n)
        import hashlib

        assert found[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_packing_fills_windows_of_each_size(spark):
    from quern.llm.packing import packed

    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices("alpha beta gamma delta".split(), k=draw.choice([5, 60, 180, 400, 900, 3000])))) for i in range(300)]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), hold=8).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    sizes = [sum(r.length for r in s) for s in by.values()]
    assert {256, 512, 1024} <= set(sizes) and all(n & (n - 1) == 0 for n in sizes)
    assert all(s[0].tier == n for s, n in zip(by.values(), sizes, strict=True))
    long = [s for s, n in zip(by.values(), sizes, strict=True) if n == 1024 and len(s) > 1]
    assert any(min(r.doc_tokens for r in s) <= 256 for s in long)  # gaps of long windows take short documents
    groups: dict = {}
    for s, n in zip(by.values(), sizes, strict=True):
        groups.setdefault(s[0].step_group, []).append(n)
    assert all(sum(g) <= 64 * 1024 for g in groups.values())


def test_quality_is_learnt(spark):
    from quern.llm.quality import quality_scores

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    held = [(got[r.doc_id].score, r.quality) for r in labels.where("quality is not null").collect() if r.doc_id in got and got[r.doc_id].held_out]
    right = sum((s >= 0.7) == (q == 1) for s, q in held)
    assert len(held) > 20 and right >= 0.9 * len(held)


def test_mixed_rows_follow_their_copies(spark):
    from quern.llm.mixing import mixed, mixture

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    named = docs.selectExpr("*", "doc_id as n__", "1 as i__")
    copies = {r.doc_id: r.copies for r in mixture(docs, labels).collect()}
    seen: dict = {}
    for r in mixed(named, labels).collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
        assert r.n__ == r.doc_id
    assert seen == {k: n for k, n in copies.items() if n}


def test_pipeline_stages(spark):
    """Each stage of the pipeline against what it was given, over a small table."""
    import corpus_pipeline as p
    from tests.llm.test_jaccard import brute

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = base.limit(20).selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    docs = base.unionByName(copies).cache()
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "exact_dedup", "near_duplicates", "mixing", "packing"]
    stage = dict(p.STAGES)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    exact = stage["exact_dedup"](spark, docs, sf)
    assert exact.columns == docs.columns
    by: dict = {}
    for i, t in rows.items():
        by[t] = max(i, by.get(t, i))
    assert {r.doc_id for r in exact.collect()} == set(by.values())
    near = stage["near_duplicates"](spark, docs, sf)
    listed = list(rows.items())
    want = brute(listed)
    assert {r.doc_id for r in near.collect()} == {i for k, (i, _) in enumerate(listed) if want[k][1] == i or want[k][0] == 0}
    kept = stage["quality"](spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    empty = docs.limit(0)
    for n, f in p.STAGES:
        assert f(spark, empty, sf).count() == 0, n


@pytest.mark.parametrize("least", [10, 30])
def test_repeated_spans_equal_a_plain_search(spark, least):
    from quern.llm.spans import sentences, without_repeats

    draw = random.Random(6)
    pool = [" ".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) + ". " for _ in range(14)]
    rows = []
    for i in range(60):
        rows.append((draw.choice([None, i, i // 3]), "".join(draw.choices(pool, k=draw.randint(0, 9)))))
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, None)]
    cut = []
    for _, text in rows:
        data = (text or "").encode()
        starts = [*sentences(data)[0].tolist(), len(data)]
        cut.append([(a, b, tuple(data[a:b].lower().split())) for a, b in zip(starts, starts[1:], strict=False)])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, gone = set(), [[False] * len(c) for c in cut]
    for i in order:
        for k in range(len(cut[i]) - 2):
            run = tuple(x[2] for x in cut[i][k : k + 3])
            if sum(map(len, run)) >= 10:
                if run in seen:
                    gone[i][k : k + 3] = [True] * 3
                seen.add(run)
    want = []
    for i, (doc_id, text) in enumerate(rows):
        k = 0
        while k < len(cut[i]):
            j = k
            while j < len(cut[i]) and gone[i][j]:
                j += 1
            if j > k and sum(len(x[2]) for x in cut[i][k:j]) < least:
                gone[i][k:j] = [False] * (j - k)
            k = max(j, k + 1)
        data = (text or "").encode()
        want.append((doc_id, sum(gone[i]), b"".join(data[a:b] for (a, b, _), g in zip(cut[i], gone[i], strict=True) if not g).decode() if cut[i] else (text or "")))
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), least=least).collect()
    assert sorted(((r.doc_id, r.n_removed, r.clean_text) for r in got), key=str) == sorted(want, key=str)
    assert any(w[1] for w in want)
