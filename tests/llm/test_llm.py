"""Operators of the llm subpackage against brute force, round trips and awkward rows."""

import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, digest string"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One two"), (6, LONG), (7, LONG + " end"), (8, LONG), (8, LONG), (9, "a b c d e f g"), (None, "a b c d e f g"), (10, "x" * 70000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "clash") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, None, None), (9, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    from quern.llm.tokens import token_counts, vocabulary

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for chunk in (1 << 16, 300):
        got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, chunk=chunk, overlap=8).collect())
        assert got == sorted((i or 0, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS)
    assert token_counts(none).count() == 0


def test_splicing_at_odd_places():
    from tokenizers import Tokenizer

    from quern.llm.tokens import tokenizer, vocabulary

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for x in ["a  b", " x ", "\n \n b", "u<|endoftext|>v <|endoftext|>", "don't  'll 's", "é \x85 b ü" * 99, "tab\t x\n\n  y  " * 40, "q" * 5000]:
        assert np.frombuffer(tokenizer(vocabulary("byte_bpe_50k.json"), 64, 2).ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_round_trip(docs, none):
    from quern.llm.packing import packed
    from quern.llm.tokens import tokenizer, vocabulary

    rows = [r.asDict() for r in packed(docs.where("doc_id <> 8"), hold=4).collect()]
    t = tokenizer(vocabulary("byte_bpe_50k.json"))
    for i, x in ROWS:
        if i in (None, 8):
            continue
        raw, at = t.ids(x or "") + bytes(4), 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(raw) // 4
            at += r["length"]
            assert zlib.crc32(raw[4 * r["start"] : 4 * at]) == r["ids_crc32"]
        assert at == len(raw) // 4
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packed(none).count() == 0


def test_exact_groups(docs, none):
    from quern.llm.dedup import exact_dedup, exact_groups

    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(docs).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (6, 8, 3, False), (8, 8, 3, True), (9, 9, 2, True), (None, 9, 2, False)} <= got
    assert exact_dedup(docs).columns == docs.columns and exact_groups(none).count() == 0


def test_near_duplicates(docs, none):
    from quern.llm.jaccard import near_duplicates

    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 9), (None, 9), (10, 10)}
    assert near_duplicates(none).count() == 0


def test_region_join_equals_brute_force():
    from quern.llm.jaccard import joined_region, linked

    rng = np.random.default_rng(1)
    base = [np.sort(rng.choice(500, 40, replace=False)) for _ in range(12)]
    sets = [np.unique(np.r_[rng.permutation(b)[: rng.integers(30, 40)], rng.choice(500, rng.integers(0, 6))]).astype(np.uint64) for b in base for _ in range(8)]

    def parts(links):
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            up[find(a)] = find(b)
        return {frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))}

    brute = [(i, j) for i in range(len(sets)) for j in range(i) if linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 75)]
    assert parts(joined_region(list(range(len(sets))), sets, 75)) == parts(brute)


def test_secret_spans(spark, none):
    from quern.llm.secrets import report, secret_spans

    docs = spark.createDataFrame([(1, "x password = 'abc123' AKIA" + "A" * 16), (2, None), (3, "token:abc " + "0a" * 12)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in report(secret_spans(docs)).collect()}
    assert got == {1: "assign:2:20,access:22:42", 2: "", 3: "hex:10:34"}
    assert secret_spans(none).count() == 0


def test_quality_and_mixing_take_awkward_rows(docs, none, labels):
    from quern.llm.mixing import mixed, mixture
    from quern.llm.quality import quality_filter, quality_scores

    got = quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_filter(docs, labels).columns == docs.columns
    assert quality_scores(none, labels.limit(0)).count() == 0
    assert mixture(docs, labels).count() == len(ROWS) == mixture(docs, labels.limit(0)).where("copies = 1").count()
    assert mixture(none, labels.limit(0)).count() == 0
    assert mixed(docs, labels.limit(0)).count() == len(ROWS)


def test_nearest(spark):
    from quern.llm.neighbours import nearest

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, k=5).collect()
    both, ids = np.r_[v, v[:1]], np.r_[np.arange(300), 403]
    hits = 0
    for q in range(0, 300, 20):
        order = [i for i in ids[np.lexsort((ids, -(both @ v[q])))] if i != q][:5]
        hits += len(set(order) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 15 * 5
    assert nearest(df.limit(0)).count() == 0


def test_context_trees(docs, none):
    from quern.llm.ctw import lm_scores

    got = lm_scores(docs).collect()
    assert len(got) == len(ROWS) and all(r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm_scores(none).count() == 0


def test_context_trees_see_six_bytes(spark):
    from quern.llm.ctw import HELD, lm_scores

    # What follows "bcdef" is told by the byte before it alone, six bytes back.
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == HELD][0]
    rows = [(i, "abcdefg" * 40 + "xbcdefh" * 40) for i in range(100) if zlib.crc32(str(i).encode()) % 5 != HELD] + [(held, "abcdefgxbcdefhabcdefg" * 20)]
    bits = {r["doc_id"]: r["bits_per_byte"] for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = lm_scores(spark.createDataFrame([*rows[:-1], (held, "abcdefhxbcdefgabcdefh" * 20)], "doc_id long, text string")).where(f"doc_id = {held}").first()["bits_per_byte"]
    assert wrong > bits[held] + 0.5


def test_repeated_spans(spark, docs, none):
    from quern.llm.spans import without_repeats

    passage = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa. Lambda mu nu xi omicron. "
    df = spark.createDataFrame([(1, passage + "First one ends here."), (2, "Second begins so. " + passage), (3, "Nothing here is shared. Not at all.")], "doc_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in without_repeats(df).collect()}
    assert got == {1: passage + "First one ends here.", 2: "Second begins so. ", 3: "Nothing here is shared. Not at all."}
    assert without_repeats(docs).count() == len(ROWS) and without_repeats(none).count() == 0


def test_repeated_spans_keep_a_first_place(spark):
    from quern.llm.spans import without_repeats

    passage = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa. Lambda mu nu xi omicron."
    other = "Not one of these words. Is there a second time. Nor are these here either."
    rows = [(1, passage), (1, passage), (None, other), (None, other), (None, "Rho sigma tau upsilon phi. Chi psi omega one two. Three four five six seven.")]
    got = sorted(r["clean_text"] for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(["", "", passage, other, rows[4][1]])


def test_exact_dedup_keeps_texts_of_null_ids(spark):
    from quern.llm.dedup import exact_dedup

    df = spark.createDataFrame([(None, "alone"), (None, "shared"), (1, "shared"), (2, "two"), (3, "two"), (2, "else")], "doc_id long, text string")
    assert {tuple(r) for r in exact_dedup(df).collect()} == {(None, "alone"), (1, "shared"), (3, "two"), (2, "else")}


def test_near_duplicates_of_null_ids(spark):
    from quern.llm.jaccard import near_duplicates

    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base)), (None, " ".join(base)), (1, " ".join(["x", *base[1:]])), (2, " ".join([*base[:-1], "y"])), (3, "far from all of these words"), (None, "alone and without any id")]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 1), (1, 1), (2, 1), (3, 3), (None, None)}


@pytest.mark.parametrize("sure", [0.95, 0.999])
def test_rates_meet_their_targets(spark, sure):
    from pyspark.sql import functions as F

    from quern.llm.mixing import TARGETS, fitted_rates, rate_of

    rng, ridge = np.random.default_rng(3), 1e-3
    rows = []
    for k, n in ((0, 600), (1, 300), (2, 10)):
        p = np.full((n, 3), 0.0)
        p[:, k] = np.minimum(1, sure + rng.normal(size=n) * (1 - sure) / 4)
        p[:, (k + 1) % 3] = 1 - p[:, k]
        rows += [(100, np.round(x, 3).tolist()) for x in p]
    found = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    multipliers, left = fitted_rates(found, TARGETS, ridge)
    # At 0.95 no rates reach the target of toxic, as each clean text has more of it.
    assert sure < 0.99 or max(map(abs, left)) < 0.05
    rate = np.array([r[0] for r in found.select(rate_of(F.col("p"), multipliers, ridge)).collect()])
    p = np.array([r[1] for r in rows])
    tokens, first = 100 * rate @ p, 100 * p.sum(0)
    push = p @ ((tokens - first[0] * np.array([1, 0.01 / 0.97, 0.02 / 0.97])) / first) + ridge * (rate - 1)
    assert np.abs(np.where(rate > 0, push, np.minimum(push, 0))).max() < 1e-5
