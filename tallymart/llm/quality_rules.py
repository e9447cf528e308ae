"""Quality rules as a ledger of bits.

Each rule is evaluated once for each text. The ledger stores one bit for each
rule that failed, next to the measurements. A policy is a named, versioned mask
of rules: applying one, changing one, or asking what each rule costs reads bits,
never the texts again. DataFrame expressions only, a map over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` says from the measurements, by name, whether a text fails."""

    name: str
    failed: Callable[[Column], Column]


#: The bit of a rule is its place here; append new rules, never reorder.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule(
        "word_length",
        lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    ),
    Rule("capitals", lambda m: 2 * m["n_capitals"] > m["n_letters"]),
    Rule("shouting", lambda m: 5 * m["n_shouts"] > m["n_words"]),
    Rule("few_letters", lambda m: 4 * m["n_letters"] < m["word_chars"]),
)


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a text."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: 1 << at for at, rule in enumerate(RULES)}
        return sum(bits[name] for name in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
CORPUS = Policy("corpus", 1, tuple(rule.name for rule in RULES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def measured(text: Column) -> Column:
    """All measurements of a text as one struct of longs; null counts as empty.

    Words are runs of other characters than space, tab, LF, VT, FF and CR; lines
    are split at LF and count if they hold a word.
    """
    text = F.coalesce(text, F.lit(""))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CHARACTER))
    words = F.array_remove(F.split(text, SPACE), "")
    from_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("repeat")))
    from_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    measures = {
        "n_words": from_words["n"],
        "word_chars": left(SPACE),
        "n_symbols": F.length(text) - left(r"[#*$%&|<>]+"),
        "n_dup_lines": from_lines["n"] - from_lines["distinct"],
        "n_repeat_words": from_words["repeat"],
        "n_lines": from_lines["n"],
        "n_letters": left(r"[^\p{L}]+"),
        "n_capitals": left(r"[^\p{Lu}]+"),
        "n_shouts": (F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2,
    }
    return F.struct(*[value.cast("long").alias(name) for name, value in measures.items()])


def _repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that the text holds twice or more.

    Windows are compared by hash; only where two hashes are equal, which few texts
    have, the windows of equal hash are compared as text.
    """

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda at: F.xxhash64(*[F.get(hashes, at + k) for k in range(WINDOW)]),
        )

    def exact(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda value, at: F.struct(value.alias("value"), at.alias("at")))
        text_of = lambda at: F.struct(
            F.concat_ws(" ", F.slice(words, at + 1, WINDOW)).alias("value"), at.alias("at")
        )
        return let(
            F.array_sort(_places_of_equal(F.transform(_places_of_equal(pairs), text_of))),
            _covered,
        )

    return F.when(
        F.size(words) > WINDOW,
        let(
            F.transform(words, lambda word: F.xxhash64(word)),
            lambda hashes: let(
                windows(hashes),
                lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), exact(found)).otherwise(0),
            ),
        ),
    ).otherwise(0)


def _places_of_equal(pairs: Column) -> Column:
    """The places ``at`` of all pairs whose ``value`` occurs more than once."""

    def neighbours(ordered: Column) -> Column:
        def place(pair: Column, k: Column) -> Column:
            same = (F.get(ordered, k - 1)["value"] == pair["value"]) | (
                F.get(ordered, k + 1)["value"] == pair["value"]
            )
            return F.when(same, pair["at"])

        return F.filter(F.transform(ordered, place), lambda at: at.isNotNull())

    return let(F.sort_array(pairs), neighbours)


def _covered(places: Column) -> Column:
    """The number of words in the windows that begin at the ascending places."""
    return F.aggregate(
        F.transform(places, lambda at, k: F.least(F.coalesce(F.get(places, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda total, more: total + more,
    )


def failure_bits(measures: Column) -> Column:
    """One long with the bit of each failed rule."""
    bits = [F.when(rule.failed(measures), F.lit(1 << at)).otherwise(0).cast("long") for at, rule in enumerate(RULES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def passes(failed: Column, policy: Policy) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, every measurement, and ``failed``, the bits of the failed rules, for each row.

    A null text counts as empty, and an empty text fails ``few_words``. Rows are
    independent: repeated and null keys give a row each. Other columns of the
    input are not read.
    """
    measures = df.select(F.col(key).alias("key"), F.explode(F.array(measured(F.col(text)))).alias("m"))
    return measures.select(F.col("key").alias(key), "m.*", failure_bits(F.col("m")).alias("failed"))


def passing(df: DataFrame, policy: Policy = CORPUS, text: str = "text") -> DataFrame:
    """The rows whose text passes a policy, with the columns of the input, whatever their names."""
    rows = df.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    measures = rows.select("row", F.explode(F.array(measured(F.col("text")))).alias("m"))
    return measures.where(passes(failure_bits(F.col("m")), policy)).select("row.*")


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: ``n_failed`` of it, ``n_only`` of it alone, ``n_kept`` without it.

    The ledger is counted by its bits first; as many rows as there are
    combinations of failures go on, and each ablation is a mask on these.
    """
    bits = [(rule.name, 1 << at) for at, rule in enumerate(RULES) if rule.name in policy.rules]
    choices = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in bits])
    counted = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(
        F.count("*").alias("n")
    )
    rest = F.col("failed").bitwiseAND(F.lit(policy.mask).bitwiseXOR(F.col("choice.bit")))
    hit = F.col("failed").bitwiseAND(F.col("choice.bit")) != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return (
        counted.withColumn("choice", F.explode(choices))
        .groupBy(F.col("choice.rule").alias("rule"))
        .agg(
            total(hit).alias("n_failed"),
            total(hit & (rest == 0)).alias("n_only"),
            total(rest == 0).alias("n_kept"),
        )
    )
