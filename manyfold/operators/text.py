"""Full text: tokens, BM25, prefix, phrase, proximity and fuzzy matching, stemming."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settled

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, combining marks dropped; null: none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}", "")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(text: str) -> list[str]:
    """The distinct terms of a query, in order."""
    import unicodedata

    plain = "".join(c for c in text.lower() if not unicodedata.category(c).startswith("M"))
    return list(dict.fromkeys(re.findall(r"[^\W_]+", plain)))


def bm25(docs: DataFrame, column: str, query: str, key: str, prefix: bool = False) -> DataFrame:
    """key and score of the documents that have any of the query's terms (or a term that begins with one).

    Two passes without a shuffle of text: one gathers the number of documents, their mean length and each term's
    document frequency (as many figures as terms); the other scores each row where it lies. Terms with a prefix may be
    any number: there the matching words of each row are written down, and meet a table of terms."""
    words = tokens(F.col(column))
    terms = query_terms(query)
    base = docs.where(F.col(column).isNotNull()).select(F.col(key), words.alias("w"))
    if prefix and terms:
        return _by_prefix(base, terms, key)
    if not terms:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).where(F.lit(False))
    has = [F.count(F.when(F.array_contains("w", t), 1)) for t in terms]
    n, mean, *dfs = base.agg(F.count(F.lit(1)), F.avg(F.size("w")), *has).first()
    total = F.lit(0.0)
    for t, df in zip(terms, dfs):
        idf = F.lit(float(_idf(n, df)))
        tf = F.size(F.filter("w", _equals(t))).cast("double")
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("w") / F.lit(float(mean or 1))))
    return base.where(F.arrays_overlap("w", F.array(*[F.lit(t) for t in terms]))).select(key, total.alias("score"))


def _by_prefix(base: DataFrame, prefixes: list[str], key: str) -> DataFrame:
    starts = lambda t: functools.reduce(lambda a, b: a | b, [t.startswith(p) for p in prefixes])
    n, mean = base.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    rows = base.select(F.col(key).alias("_key"), F.size("w").alias("_len"), F.filter("w", starts).alias("_hits")).where(F.size("_hits") > 0)
    rows = settled(rows.withColumn("_row", F.monotonically_increasing_id()), "hits")
    tfs = rows.select("_row", "_key", "_len", F.explode("_hits").alias("_t")).groupBy("_row", "_key", "_len", "_t").agg(F.count(F.lit(1)).cast("double").alias("_tf"))
    dfs = tfs.groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1 + (F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.lit(float(mean or 1))))
    return tfs.join(dfs, "_t").groupBy("_row", "_key").agg(F.sum(part).alias("score")).select(F.col("_key").alias(key), "score")


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def _idf(n: int, df: int) -> float:
    import math

    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length in bytes; 1 for two empty texts."""
    most = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def fuzzy_score(score: Column, sim: Column, weight: float) -> Column:
    return score * (1 - weight) + sim * weight


def phrase(text: Column, query: str) -> Column:
    """Whether the query's words come in order, with gaps or without."""
    step = lambda at, w: F.when((at < len(words)) & (F.get(wanted, at) == w), at + 1).otherwise(at)
    words = re.findall(r"\S+", query.lower())
    wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    found = F.aggregate(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"), F.lit(0), step)
    return found == len(words)


def all_terms(text: Column, query: str) -> Column:
    """Whether every word of the query is in the text."""
    words = F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+")
    out = F.lit(True)
    for w in dict.fromkeys(re.findall(r"\S+", query.lower())):
        out = out & F.array_contains(words, w)
    return out


def proximity(text: Column, query: str, slop: int) -> Column:
    """Whether the first places of the query's terms follow one another, each 1 to slop + 1 after the one before."""
    words, terms = tokens(text), re.findall(r"[^\W_]+", query.lower())
    if not terms:
        return F.lit(False)
    at = [F.array_position(words, t) for t in terms]
    out = at[0] > 0
    for a, b in zip(at, at[1:]):
        out = out & (b > 0) & (b - a).between(1, slop + 1)
    return out


_SUFFIXES = ("ing", "tion", "ed", "er", "est", "ly", "ment", "ness", "s")


def naive_stem(word: Column) -> Column:
    """The first of a few suffixes that leaves more than two letters goes; words of up to three letters stay."""
    w = F.lower(word)
    out = F.when(F.length(w) <= 3, w)
    for s in _SUFFIXES:
        out = out.when(w.endswith(s) & (F.length(w) > len(s) + 2), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def _measure(stem: str) -> int:
    return len(re.findall("VC", re.sub("(.)\\1+", "\\1", "".join("V" if _vowel(stem, i) else "C" for i in range(len(stem))))))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


_TWO = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_THREE = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter_stem(word: str) -> str:
    """Porter's algorithm; words of other than ASCII letters, or of up to two, stay."""
    w = word.lower()
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    has_vowel = lambda s: any(_vowel(s, i) for i in range(len(s)))
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_TWO, _THREE):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                if _measure(w[: -len(s)]) > 0:
                    w = w[: -len(s)] + table[s]
                break
    for s in sorted(_FOUR, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def porter(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Porter's stem of a column of words; a word is stemmed once a batch."""
    for s in words:
        yield s.map({w: porter_stem(w) for w in s.dropna().unique()})
