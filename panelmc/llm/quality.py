"""Quality rules (operator 1): a ledger of rule bits, policies over it, and ablations. DataFrame functions only.

Every rule is evaluated once a document. The ledger keeps the measurements and a bit for each failed rule; a policy is a
version and a mask, so another policy or an ablation reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Rules in the order of their bits, over the measurements' names; a row that meets the condition fails the rule.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "exclamations": "10 * n_exclaim > 3 * n_words",
    "capitals": "10 * n_capitals > 4 * word_chars",
    "stutter": "10 * n_stutter > 3 * n_words",
    "word_length": "word_chars > 16 * n_words or word_chars < 2 * n_words",
}


def mask(*rules: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in rules)


#: Versions of policies: the rules that each rejects by.
POLICIES: dict[str, int] = {"v1": mask("few_words", "repeated_windows"), "v2": mask(*RULES)}
BASE = POLICIES["v1"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and measurements. Null texts count as empty. Windows are compared by 64-bit hashes."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    cut = text.select("doc_id", "t", F.array_remove(F.split("t", WHITE, -1), "").alias("words"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    places = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashed = cut.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclaim"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.when(n > 1, F.size(F.filter(F.zip_with(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1), lambda a, b: a == b), lambda x: x))).otherwise(0).cast("long").alias("n_stutter"),
        F.transform(places, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("h"),
    )
    names = hashed.columns[:-1]
    twice = F.size(F.array_distinct("h")) < F.size("h")
    # only where some window is there twice: hashes with their places, in order, so that equal ones are neighbours
    ordered = hashed.select(*names, F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))).alias("s"))
    s = F.col("s")

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

    again = F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(again, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW).cast("long"), i - a["last"])).alias("n")), lambda a: a["n"])
    found = F.struct(*names[1:], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # as a generator's output, so that a filter on measurements stays above them and does not repeat the work for each mention
    return ordered.select("doc_id", F.inline(F.array(found)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements, failed (bit i: the i-th of RULES failed) of every row. Other columns of docs are left out; rows with equal doc_ids are each a row."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured(docs).withColumn("failed", bits.cast("long"))


def judged(rows: DataFrame, version: str = "v2", policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """A ledger with policy (the version), base_failed and kept."""
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    hit = F.col("failed").bitwiseAND(F.lit(policies[version])) != 0
    return rows.withColumns({"policy": F.lit(version), "base_failed": base, "kept": ~base & ~hit})


def ablations(rows: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Of each policy and rule in it: n_failed (rows that fail the rule), n_only (rows kept if this rule were left out) and n_rejected (by the policy).
    The ledger is summed by its bits first, of which there are at most 2 ** len(RULES) combinations."""
    sums = rows.groupBy("failed").agg(F.count("*").alias("n"))
    known = [(v, m, r, 1 << i) for v, m in policies.items() for i, r in enumerate(RULES) if m >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, r, b in known]))
    hit = F.col("failed").bitwiseAND(F.col("p.mask"))
    return (
        sums.select("failed", "n", each.alias("p"))
        .groupBy("p.policy", "p.rule")
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("p.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("p.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        )
    )
