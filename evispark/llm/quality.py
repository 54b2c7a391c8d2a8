"""Quality rules as a ledger: every rule is evaluated once, its measurements and a failure bit are stored, and versioned
policies and ablations work on the stored bits alone. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column


def measurements(split: DataFrame) -> dict[str, Column]:
    """What the rules look at, from the columns ``_text``, ``_words``, ``_windows`` and ``_lines``."""
    body = F.col("_text")
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda acc, w: acc + F.char_length(w)),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(
            repeated_words(F.col("_windows"))
        ),
        "n_lines": F.size("_lines").cast("long"),
        "n_shouts": (F.octet_length(body) - F.octet_length(F.replace(body, F.lit("!"), F.lit("")))).cast("long"),
    }


def windows(tokens: Column) -> Column:
    """A 64-bit hash of each three words in a row."""
    return F.transform(
        F.slice(tokens, F.lit(3), F.greatest(F.size(tokens) - 2, F.lit(0))), lambda third, i: F.xxhash64(tokens[i], tokens[i + 1], third)
    )


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text, the first find included.

    Windows (one for each place) are sorted by hash with their places, those beside an equal hash are repeated, and the
    places they cover are counted after another sort. So the work for a text of n words is in the order of n log n.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, y: x["h"] == y["h"]
    repeated = let(
        placed,
        lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(same(x, F.try_element_at(s, i + 2)), F.lit(False)) | ((i > 0) & same(x, F.try_element_at(s, F.greatest(i, F.lit(1))))),
        ),
    )
    return let(
        F.array_sort(F.transform(repeated, lambda x: x["i"])),
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.try_element_at(p, i + 2) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        ),
    )


def rules() -> list[Rule]:
    """The rules, each with its own bit for ever; a changed rule takes a new bit."""
    c = F.col
    return [
        Rule(0, "few_words", c("n_words") < 50),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule(2, "symbols", 10 * c("n_symbols") > c("n_words")),
        Rule(3, "duplicate_lines", (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines"))),
        Rule(4, "shouting", 5 * c("n_shouts") > c("n_words")),
        Rule(5, "word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
    ]


#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting"),
    "strict": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "word_length"),
}


def mask(policy: str) -> int:
    """The bits that a policy rejects on."""
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[name] for name in POLICIES[policy])


def ledger(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns of ``keep``, the measurements and ``fail_bits``.

    There is no shuffle. Measurements take the place of columns of ``docs`` with the same names. Null texts count as
    empty; texts without words fail ``few_words`` and have every measurement 0. An empty table gives an empty ledger.
    """
    kept = {f"_keep{i}": name for i, name in enumerate(keep)}
    text = docs.select(*(F.col(c).alias(k) for k, c in kept.items()), F.coalesce("text", F.lit("")).alias("_text"))
    split = text.withColumns({"_words": words(F.col("_text")), "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))})
    split = split.withColumn("_windows", windows(F.col("_words")))
    measured = split.select(*kept, *(value.alias(name) for name, value in measurements(split).items()))
    bits = sum((F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules()), F.lit(0).cast("long"))
    # A partition's number, times 0, keeps the optimiser from copying all measurements into filters on the bits.
    found = measured.withColumn("fail_bits", bits + F.spark_partition_id() * 0)
    named = [c for c in keep if c not in found.columns]
    return found.select(*(F.col(k).alias(c) for k, c in kept.items() if c in named), *(c for c in found.columns if c not in kept))


def apply_policy(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``kept``: whether none of the policy's rules failed. Only stored bits are read."""
    return ledger_rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that it alone rejects, and that the policy keeps without it.

    The ledger is first counted by its bits, so at most two to the number of rules rows go on.
    """
    whole = mask(policy)
    counts = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules() if r.name in POLICIES[policy])))
    on = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        counts.withColumn("r", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(on, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(whole) - F.col("r.bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def judged(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger of ``docs`` with the verdicts of the base rules and of a policy."""
    found = apply_policy(ledger(docs), policy).withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
