"""Fact tables: nodes, edges, evidence and imports over the star schema, and their upsert rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "repo"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable_id(qualified_name: Column, language: str = "ts", root: str = ROOT) -> Column:
    """sha256 of root, language and qualified name."""
    return F.sha2(F.concat_ws("::", F.lit(root), F.lit(language), qualified_name), 256)


def version_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


#: Digits of a key that `coded` has room for.
DIGITS = 16


#: Node kind, table, key column, name column.
NODES = [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("order", "orders", "o_orderkey", "o_orderpriority")]


KINDS = sorted(k for k, *_ in NODES)
_shift = lambda n: F.element_at(F.array(*(F.lit(10 ** (DIGITS - i)).cast("long") for i in range(1, DIGITS + 1))), n)


def coded(kind: str, column: str) -> Column:
    """key(kind, column) as a long that sorts as that text does: the kind, the key's digits moved to the left, and
    how many they are. It takes an eighth to a quarter of the text's place; keys are 0 to 10^16 - 1."""
    n = F.length(F.col(column).cast("string"))
    return (F.lit(KINDS.index(kind) * 10**DIGITS) + F.col(column).cast("long") * _shift(n)) * 32 + n


def decoded(code: Column) -> Column:
    """The text that `coded` stands for."""
    n, rest = (code % 32).cast("int"), F.shiftright(code, 5)
    digits = rest % F.lit(10**DIGITS)
    kind = F.element_at(F.array(*(F.lit(f"{k}:") for k in KINDS)), (((rest - digits) / 10.0**DIGITS).cast("int") + 1))
    shift = _shift(n)
    return F.concat(kind, F.call_function("div", digits, shift).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, ids: Callable[[str, str], Column] = key) -> DataFrame:
    """Node facts: node_id (the qualified name, or what `ids` makes of it), stable_id, kind, name."""
    parts = [table(spark, sf_dir, t).select(ids(kind, k).alias("node_id"), F.lit(kind).alias("kind"), F.col(n).alias("name"), key(kind, k).alias("text")) for kind, t, k, n in NODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("stable_id", stable_id(F.col("text"))).drop("text")


def edges(spark: SparkSession, sf_dir: str, ids: Callable[[str, str], Column] = key) -> DataFrame:
    """Edge facts with their tiers, one row for each (source, target, kind)."""

    def of(t: str, source: tuple, target: tuple, kind: str, tier: int) -> DataFrame:
        return table(spark, sf_dir, t).select(ids(*source).alias("source_id"), ids(*target).alias("target_id"), F.lit(kind).alias("kind"), F.lit(tier).alias("verification"))

    keyed = of("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "CONTAINS", 4)
    keyed = keyed.unionByName(of("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "REFERENCES", 4))
    keyed = keyed.unionByName(of("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "REFERENCES", 4))
    keyed = keyed.unionByName(of("orders", ("order", "o_orderkey"), ("customer", "o_custkey"), "CALLS", 4))
    lines = [of("lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey"), "CALLS", 3), of("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), "CALLS", 2)]
    return keyed.unionByName(lines[0].distinct()).unionByName(lines[1].distinct())


def small_keys(spark: SparkSession, sf_dir: str) -> bool:
    """Whether `coded` has room for all keys of nodes and edges."""
    ends = [(t, k) for _, t, k, _ in NODES] + [("nation", "n_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey")]
    by = {t: [k for u, k in ends if u == t] for t, _ in ends}
    sides = [table(spark, sf_dir, t).agg(*(f(F.col(k).cast("long")).alias(f"{f.__name__}{i}") for i, k in enumerate(ks) for f in (F.min, F.max))).select(F.explode(F.array(*(f"{f}{i}" for i in range(len(ks)) for f in ("min", "max")))).alias("k")) for t, ks in by.items()]
    out = sides[0]
    for x in sides[1:]:
        out = out.unionByName(x)
    low, high = out.agg(F.min("k"), F.max("k")).first()
    return low is None or (low >= 0 and high < 10**DIGITS)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed calls of users, append-only: the tier by event type, the event's id as its place in time."""
    tier = F.element_at(F.create_map(*(x for k, v in {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}.items() for x in (F.lit(k), F.lit(v)))), F.col("event_type"))
    return table(spark, sf_dir, "events").select(key("user", "user_id").alias("source_id"), F.concat(F.lit("event:"), "event_type").alias("target_id"), F.lit("OBSERVED_CALL").alias("kind"), F.coalesce(tier, F.lit(0)).alias("verification"), F.lit("events").alias("source_method"), F.col("props").alias("metadata"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import index: part k imports part k div 2."""
    p = table(spark, sf_dir, "part").where("p_partkey >= 2")
    return p.select(key("part", "p_partkey").alias("importer_file"), F.expr("concat('part:', cast(p_partkey div 2 as string))").alias("imported_file"))


def upserted(rows: DataFrame, by: str, seq: str = "seq") -> DataFrame:
    """B1: the last row of each key, with the first language and the last known previous id."""
    rest = [c for c in rows.columns if c not in (by, "language", "previous_stable_id")]
    out = rows.groupBy(by).agg(*(F.max_by(c, seq).alias(c) for c in rest), F.min_by("language", seq).alias("language"), F.max_by("previous_stable_id", F.when(F.col("previous_stable_id").isNotNull(), F.col(seq))).alias("previous_stable_id"))
    return out.select(*rows.columns)
