"""Joins of strings by the share of edits between them, exact and without comparing all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Share below which a text may have no part that its partner must hold, by measure.
LEAST = {"indel": 2 / 3, "levenshtein": 1 / 2}
EPS = 1e-9


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        met = state & places.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - (insertions and deletions) / (both lengths); 1 for two empty texts, null if one is null."""
    null = lambda x: x is None or x != x
    one = lambda x, y: None if null(x) or null(y) else 2 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def indel_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """A row for each text of the first list with its `indel_ratio` to each text of the second; no text is null or empty."""
    return pd.Series([[[2 * common_length(s, t) / (len(s) + len(t)) for t in y] for s in x] for x, y in zip(a, b, strict=True)], dtype=object)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - (insertions, deletions and replacements) / (the greater length); 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def check_bounds(threshold: float, measure: str) -> None:
    """Refuses unknown measures, and thresholds that a measure can't be searched with."""
    if measure not in LEAST:
        raise ValueError(f"measure is one of {sorted(LEAST)}")
    if not LEAST[measure] < threshold <= 1:
        raise ValueError(f"the threshold of {measure} is above {LEAST[measure]:.3f} and at most 1")


def _bounds(threshold: float, measure: str):
    """Functions of lengths (short, long): the longest partner of a short text, the shortest of a long one, and the most edits between two."""
    check_bounds(threshold, measure)
    r = threshold
    if measure == "indel":
        grow, edits = (2 - r) / r, lambda s, t: F.floor((1 - r) * (s + t) + EPS).cast("int")
    else:
        grow, edits = 1 / r, lambda s, t: F.floor((1 - r) * t + EPS).cast("int")
    return lambda s: F.floor(s * grow + EPS).cast("int"), lambda t: F.ceil(t / grow - EPS).cast("int"), edits


def _places(rows: DataFrame) -> DataFrame:
    """Rows with _n (length of the shorter text) and _k (edits) get a row for each of its _k + 1 segments: _i, where it begins (_p, from 1) and its length _m."""
    base, longer = F.expr("_n div (_k + 1)").cast("int"), F.col("_n") % (F.col("_k") + 1)
    plain = F.col("_k") + 1 - longer
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    return rows.withColumns({"_m": base + (F.col("_i") >= plain).cast("int"), "_p": F.col("_i") * base + F.greatest(F.lit(0), F.col("_i") - plain) + 1})


def _near(short: DataFrame, long: DataFrame, within: list[str], threshold: float, measure: str, also: str) -> DataFrame:
    """(within..., _s, _t): texts _t of short and of long with length(_s) <= length(_t) that may reach the threshold (all that do are there), if `also` holds."""
    longest, shortest, edits = _bounds(threshold, measure)
    s = short.select(*within, F.col("_t").alias("_s"), F.length("_t").alias("_n"))
    s = _places(s.withColumn("_k", edits(F.col("_n"), longest(F.col("_n")))))
    s = s.select(*within, "_s", F.xxhash64("_n", "_i", F.expr("substring(_s, _p, _m)")).alias("_h"))
    t = long.select(*within, "_t", F.length("_t").alias("_l"))
    t = t.withColumn("_n", F.explode(F.sequence(shortest(F.col("_l")), F.col("_l"))))
    t = _places(t.withColumn("_k", edits(F.col("_n"), longest(F.col("_n")))))
    shift, after = F.col("_l") - F.col("_n"), F.col("_k") - F.col("_i")
    # edits before the segment move it by its number at most, those after it by the rest
    first = F.greatest(F.lit(1), F.col("_p") - F.col("_i"), F.col("_p") + shift - after)
    last = F.least(F.col("_l") - F.col("_m") + 1, F.col("_p") + F.col("_i"), F.col("_p") + shift + after)
    t = t.withColumns({"_from": first, "_to": last}).where("_from <= _to").withColumn("_at", F.explode(F.sequence("_from", "_to")))
    t = t.select(*within, "_t", F.xxhash64("_n", "_i", F.expr("substring(_t, _at, _m)")).alias("_h"))
    most = edits(F.length("_s"), F.length("_t"))
    # the distance stops as soon as it is beyond the bound; checked in the join, so only what is near is shuffled again
    both = s.join(t, [*within, "_h"]).where(also).withColumn("_most", most).where("length(_s) <= length(_t) AND levenshtein(_s, _t, _most) >= 0")
    return both.select(*within, "_s", "_t").distinct()


def _checked(near: DataFrame, threshold: float, measure: str) -> DataFrame:
    ratio = indel_ratio("_s", "_t") if measure == "indel" else levenshtein_ratio(F.col("_s"), F.col("_t"))
    return near.withColumn("similarity", ratio).where(F.col("similarity") >= threshold - EPS)


def _texts(df: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(*within, F.col(key).alias("_key"), F.col(text).alias("_t"))


def ratio_pairs(df: DataFrame, key: str, text: str, threshold: float, within: list[str] | None = None, measure: str = "indel") -> DataFrame:
    """(a, b, similarity): pairs of rows of a group whose texts reach the threshold, a < b. Of equal texts the least key stands for all: the others are paired with it
    only, with similarity 1. Null and empty texts and rows with a null group have no pairs.

    Exact. A text is cut into one segment more than edits are allowed, so its partner holds one of them unchanged, close to its place; rows meet on these segments and
    their distance is computed with a bound. A text of n letters sends about (1 - threshold)² n² rows for each length its partners may have, so this is for names and titles.
    A segment that many texts share is split by the engine's handling of skewed joins; pairs are checked where they meet and never written out."""
    within = within or []
    rows = _texts(df, key, text, within)
    texts = rows.groupBy(*within, "_t").agg(F.min("_key").alias("_key"))
    near = _checked(_near(texts, texts, within, threshold, measure, "_s <> _t AND (length(_s) < length(_t) OR _s < _t)"), threshold, measure)
    ends = [texts.select(*within, F.col("_t").alias(c), F.col("_key").alias(k)) for c, k in (("_s", "_x"), ("_t", "_y"))]
    found = near.join(ends[0], [*within, "_s"]).join(ends[1], [*within, "_t"]).select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")
    copies = rows.join(texts.select(*within, "_t", F.col("_key").alias("a")), [*within, "_t"]).where("_key <> a").select("a", F.col("_key").alias("b"), F.lit(1.0).alias("similarity"))
    return found.union(copies)


def ratio_matches(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float, within: list[str] | None = None, measure: str = "indel") -> DataFrame:
    """(within..., a, b, similarity): for each row of left (a), the texts of right in its group that reach the threshold, each by its least key (b).
    Null and empty texts and null groups match nothing. As `ratio_pairs`, the shorter text of two being the one that is cut."""
    within = within or []
    rows = _texts(left, key, text, within)
    mine, theirs = rows.select(*within, "_t").distinct(), _texts(right, key, text, within).groupBy(*within, "_t").agg(F.min("_key").alias("b"))
    up = _near(mine, theirs, within, threshold, measure, "true").select(*within, F.col("_s").alias("_a"), F.col("_t").alias("_b"))
    down = _near(theirs, mine, within, threshold, measure, "length(_s) < length(_t)").select(*within, F.col("_t").alias("_a"), F.col("_s").alias("_b"))
    near = _checked(up.union(down).withColumnsRenamed({"_a": "_s", "_b": "_t"}), threshold, measure)
    found = near.join(theirs, [*within, "_t"]).drop("_t").withColumnRenamed("_s", "_t")
    return rows.withColumnRenamed("_key", "a").join(found, [*within, "_t"]).select(*within, "a", "b", "similarity")
