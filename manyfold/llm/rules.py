"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0) on a text. The corpus is grouped by pattern of votes (at most 3
to the number of rules, whatever the corpus), and expectation-maximisation over those patterns estimates each rule's
accuracies, among its votes on good texts and on bad ones, and the share of good texts. A text's posterior probability
of being good follows from its votes; the verdict is that probability, not the conjunction of the rules: a bad vote
of a rule that often misfires, or one that no other rule bears out, is outweighed by the other votes.

Defined results: a null or empty text has 0 in all counts, fails the base rule and isn't kept. Repeated rows get
equal results. Where the corpus is empty or all rules abstain, the prior stands. Input columns with the names of
result columns are replaced; any other names may stand in the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

WORD_BREAK = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_distinct"]


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and, as longs, COUNTS and MORE (lines with a word, upper-case letters, letters, distinct words).

    Each step is a projection of its own, so that what later steps use twice is worked out once.
    """
    keep = [c for c in keep if c.lower() not in {*COUNTS, *MORE}]
    t, s, w, l, k, o = (unused(docs, x) for x in ("_t", "_s", "_w", "_l", "_k", "_o"))  # noqa: E741
    own = [F.col(f"`{c}`") for c in keep]
    df = docs.select(*own, F.coalesce(F.col("text"), F.lit("")).alias(t))
    # white space at either end goes, so that the split makes no empty word but for an empty text
    df = df.select(*own, t, F.regexp_replace(t, rf"^{WORD_BREAK}|{WORD_BREAK}\z", "").alias(s))
    df = df.select(
        *own,
        F.when(F.col(s) == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(s, WORD_BREAK), lambda x: F.xxhash64(x))).alias(w),
        F.length(F.regexp_replace(s, WORD_BREAK, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(s, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(l),
    )
    n = F.size(w)
    df = df.select(
        *own, "word_chars", "n_symbols", "n_upper", "n_letters",
        n.cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(l).cast("long").alias("n_lines"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        # hashes of the 3-word windows
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))).alias(k),
    )
    df = df.select(
        *own, *COUNTS[:4], *MORE,
        # windows with their places, in order of hash; only where some window comes twice
        F.when(F.size(F.array_distinct(k)) < F.size(k), F.sort_array(F.transform(F.col(k), lambda x, i: F.struct(x.alias("k"), i.alias("i"))))).alias(o),
    )
    at, m = F.col(o), F.size(o)
    twice = F.filter(
        F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.when((F.get(at, j)["k"] == F.get(at, j - 1)["k"]) | (F.get(at, j)["k"] == F.get(at, j + 1)["k"]), F.get(at, j)["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return df.select(*own, *COUNTS[:4], F.when(at.isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"), *MORE)


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _three(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, by name of rule. Ratios of an empty text are null: the rules abstain."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    chars = F.nullif(F.col("word_chars"), F.lit(0))
    length, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    repeats, copies = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    upper, letters = F.col("n_upper") / chars, F.col("n_letters") / chars
    varied = F.col("n_distinct") / F.sqrt(words)  # grows slowly with length in prose, hardly in repeats
    return {
        "long_enough": _three(words, words >= 100, words < 75),
        "word_length": _three(length, length.between(3.5, 6.5), (length < 3) | (length > 7.5)),
        "few_symbols": _three(symbols, symbols < 0.05, symbols > 0.2),
        "mostly_letters": _three(letters, letters > 0.93, letters < 0.9),
        "few_repeats": _three(repeats, repeats < 0.1, repeats > 0.25),
        "few_copied_lines": _three(copies, copies < 0.1, copies > 0.3),
        "varied": _three(varied, varied > 5, varied < 3.5),
        "few_capitals": _three(upper, upper < 0.1, upper > 0.3),
    }


@dataclass
class Weights:
    """prior: log odds of good before any vote. good, bad: by rule, log odds that such a vote adds. accuracy: by rule, on
    good texts and on bad ones. converged: whether the last round moved no accuracy by more than the tolerance."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]
    accuracy: dict[str, tuple[float, float]]
    converged: bool = True


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 2000, tolerance: float = 1e-6) -> Weights:
    """EM for rules that err independently given the truth. A rule has two accuracies among its votes: on good texts (0.5
    to 0.99; beta prior of 9 right in 10) and on bad ones (0.05 to 0.99, for it may see one kind of defect only; 3
    right in 10). An abstention says nothing. The share of good texts (beta prior of 8 in 10) stays between 0.5, which
    says which of the two classes is the good one, and 0.99."""
    votes = np.array([v for v, _ in patterns], np.int64).reshape(len(patterns), len(names))
    n = np.array([c for _, c in patterns], np.float64)
    right, wrong = (votes > 0).astype(float), (votes < 0).astype(float)
    on_good, on_bad, share = np.full(len(names), 0.9), np.full(len(names), 0.3), 0.8
    converged = not n.sum()
    for _ in range(rounds if n.sum() else 0):
        odds = math.log(share / (1 - share)) + right @ np.log(on_good / (1 - on_bad)) + wrong @ np.log((1 - on_good) / on_bad)
        p = n / (1 + np.exp(-odds))
        new_good = np.clip((p @ right + 9) / (p @ (right + wrong) + 10), 0.5, 0.99)
        new_bad = np.clip(((n - p) @ wrong + 3) / ((n - p) @ (right + wrong) + 10), 0.05, 0.99)
        new_share = min(0.99, max(0.5, (p.sum() + 8) / (n.sum() + 10)))
        moved = max(np.abs(new_good - on_good).max(), np.abs(new_bad - on_bad).max(), abs(new_share - share))
        on_good, on_bad, share = new_good, new_bad, new_share
        if moved <= tolerance:
            converged = True
            break
    return Weights(
        math.log(share / (1 - share)),
        {r: math.log(a / (1 - b)) for r, a, b in zip(names, on_good, on_bad)},
        {r: math.log((1 - a) / b) for r, a, b in zip(names, on_good, on_bad)},
        {r: (float(a), float(b)) for r, a, b in zip(names, on_good, on_bad)},
        converged,
    )


def fit(counted: DataFrame) -> Weights:
    """Weights estimated from the votes on all texts of counted (see with_counts) that pass the base rule: those that
    fail it are decided, and as one kind of defect that several rules see they would pass for what bad means."""
    votes = rules()
    # grouped by it, not filtered: a filter would be pushed into the counting and work everything out anew
    rows = counted.select(base_failed().alias("out"), *[v.alias(r) for r, v in votes.items()]).groupBy("out", *votes).count().collect()  # at most 2 * 3**len(votes)
    return estimate(sorted((tuple(r[x] for x in votes), r["count"]) for r in rows if not r["out"]), list(votes))


def posterior(weights: Weights) -> Column:
    odds = F.lit(weights.prior)
    for r, v in rules().items():
        odds = odds + F.when(v == 1, weights.good[r]).when(v == -1, weights.bad[r]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(counted: DataFrame, weights: Weights, threshold: float = 0.5) -> DataFrame:
    """counted with base_failed, p_good and kept."""
    df = counted.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(weights))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
