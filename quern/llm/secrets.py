"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

DataFrame functions only. Positions come from the lengths of the parts between the matches and of the
matches themselves. The models are first-order: the log-ratio of a string is the sum, over its pairs
of neighbouring characters, of log P(next | previous, random) - log P(next | previous, identifier).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import texts

#: The fixed patterns by kind, in their order, with the group that counts and its least length (fixed values).
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Characters of candidate strings; any other has code 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(ALPHABET) + 1
#: Candidates of the models: strings of the alphabet of at least so many characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Matches of a text whose places are summed up at a time.
RUN = 256
#: What a candidate must hold: letters beside digits, or a capital after a small letter.
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]"


def spans(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """Spans (start, order, kind, end, hit) of the matches whose group has at least `least` characters."""
    rank = [*BASE, "random"].index(kind)
    seen = text.rlike(pattern) if kind != "random" else text.rlike(MIXED) & text.rlike(pattern)
    between = F.split(text, pattern, -1)
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("hit"), part.alias("part"))
    kind_of = "array<struct<start:int,rank:int,kind:string,end:int,hit:string>>"
    none = F.expr(f"cast(array() as {kind_of})")
    size = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    # Places are summed up over runs of RUN matches, and within each run, as an array that grows is copied each time.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / RUN).cast("int")), lambda i: F.slice(zipped, i * RUN + 1, F.lit(RUN)))
    ends = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    starts = F.aggregate(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + size(x))), F.array(F.lit(0)), ends)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["part"].alias("hit"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(r: Column, at: Column) -> Column:
        return F.when(r.isNotNull(), F.aggregate(r, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)

    return F.when(seen & (F.size(zipped) > 0), F.flatten(F.zip_with(runs, starts, placed))).otherwise(none)


def pair_codes(text: Column) -> Column:
    """Codes of the neighbouring pairs of characters of a string of two or more."""
    at = lambda i: F.position(F.substr(text, i, F.lit(1)), F.lit(ALPHABET))
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: at(i) * K + at(i + 1))


def fit(docs: DataFrame, sample: int = 20_000) -> list[float]:
    """Log-ratios by pair code, trained from labelled samples: strings that a fixed pattern marks are
    random, the words of at least four characters in texts without one are ordinary identifiers.

    Only about `sample` texts are looked at, chosen by the hash of their ids; the words come from a
    twentieth of them. Counts are smoothed; without any sample of a kind all ratios are 0."""
    step = max(1, docs.count() // sample)
    h = F.xxhash64("doc_id", F.lit(1))
    rows = docs.where(F.pmod(h, F.lit(step)) == 0).select("text", h.alias("h"))
    marked = F.col("text").rlike("|".join(f"(?:{p})" for p, _, _ in BASE.values()))
    hits = F.flatten(F.array(*(F.transform(spans(F.col("text"), p, k, g, n), lambda s: s["hit"]) for k, (p, g, n) in BASE.items())))
    plain = F.when(F.pmod(F.shiftright("h", 20), F.lit(20)) == 0, F.split("text", r"[^A-Za-z0-9+/_=-]+"))
    labelled = rows.select(marked.alias("random"), F.when(marked, hits).otherwise(plain).alias("strings"))
    strings = labelled.select("random", F.explode("strings").alias("s")).where((F.length("s") >= 4) | F.col("random") & (F.length("s") >= 2))
    counted = strings.select(F.col("random").cast("int"), F.explode(pair_codes(F.col("s"))).alias("pair")).groupBy("random", "pair").count().collect()
    counts = [[0.0] * (K * K), [0.0] * (K * K)]
    for r in counted:  # at most 2 * K * K rows
        counts[r["random"]][r["pair"]] = r["count"]
    if not sum(counts[0]) or not sum(counts[1]):
        return [0.0] * (K * K)
    out = []
    for a in range(K):
        rows_of = [counts[m][a * K : a * K + K] for m in (0, 1)]
        # The random model backs off to a uniform letter, and the identifiers' to a rare one.
        total = [sum(x) for x in rows_of]
        out += [math.log((rows_of[1][b] + 2) / (total[1] + 2 * K)) - math.log((rows_of[0][b] + 0.5) / (total[0] + 0.5 * K)) for b in range(K)]
    return out


def random_spans(text: Column, ratios: list[float], least: float) -> Column:
    """Candidate strings whose log-ratio is at least `least` and that mix letters with digits or cases (MIXED)."""
    table = F.array(*(F.lit(round(x, 6)) for x in ratios))
    found = spans(text, CANDIDATE, "random", 0, 16)
    ratio = lambda s: F.aggregate(pair_codes(s["hit"]), F.lit(0.0), lambda a, p: a + F.get(table, p))
    return F.filter(found, lambda s: s["hit"].rlike(MIXED) & (ratio(s) >= least))


def secret_spans(docs: DataFrame, least: float = 12.0, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, base (spans of the fixed patterns), extra (spans that the
    models add, where no base span overlaps), both by start, then kind.

    Null and empty texts have no spans; repeated rows get a row each; an empty table gives an empty
    result; other columns are left out. Starts and ends count code points, ends excluded."""
    rows = texts(docs, id_col, text_col)
    ratios = fit(rows, sample)
    base = F.array_sort(F.flatten(F.array(*(spans(F.col("text"), p, k, g, n) for k, (p, g, n) in BASE.items()))))
    extra = random_spans(F.col("text"), ratios, least)
    found = rows.select("doc_id", base.alias("base"), extra.alias("more"))
    apart = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("doc_id", "base", apart.alias("extra"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of secret_spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.array_sort(F.concat("base", "extra"))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("extra").cast("long").alias("n_random"))
