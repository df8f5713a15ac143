"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much of its text is rejected.

Words are runs without space, tab, line feed, vertical tab, form feed and carriage return; lines are split at line feeds.
Null and empty texts have no words: base_failed. Repeated rows are judged each for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, slices, table
from folioscope.llm.shingles import words as words_of

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Characters from which on windows are counted in arrays, with the same result.
LONG_TEXT = 1 << 20
#: A line of prose ends with one of these, perhaps before white space, or has a sentence's end inside (the last line of a cut text).
TERMINAL = r"""[.!?…。！？।؟۔"'”’»)\]」』）][\t\v\f\r ]*$|[.!?…।؟۔] |[。！？]"""
NAVIGATION = "|>»•·"
#: Lower-case phrases of legal, consent and page-furniture lines.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter", "skip to content", "back to top",
)


@dataclass(frozen=True)
class Rules:
    """A line fails where: it neither ends like prose nor has a sentence's end inside; it has NAVIGATION marks for a quarter of its words and two at least; it has boilerplate_words words at most and a boilerplate phrase;
    it has more than half as many symbols as words; of three words or more, capitals outnumber small letters (A-Z, a-z).
    A document fails where more than max_lost_percent of its word characters stand in failing lines."""

    max_lost_percent: int = 35
    min_words: int = 50
    max_repeat_percent: int = 50
    boilerplate_words: int = 30
    boilerplate: tuple[str, ...] = BOILERPLATE


_TERMINAL = re.compile(TERMINAL)
_CAPITALS, _SMALL = re.compile("[A-Z]+"), re.compile("[a-z]+")
_NAVIGATION, _SYMBOLS = re.compile(f"[{NAVIGATION}]"), re.compile(f"[{re.escape(SYMBOLS)}]")


def line_fault(line: str, n_words: int, rules: Rules) -> str | None:
    """The first rule that a line with words fails, if any."""
    if not _TERMINAL.search(line):
        return "punctuation"
    if len(marks := _NAVIGATION.findall(line)) >= 2 and 4 * len(marks) >= n_words:
        return "navigation"
    if n_words <= rules.boilerplate_words and any(x in line.lower() for x in rules.boilerplate):
        return "boilerplate"
    if 2 * len(_SYMBOLS.findall(line)) > n_words:
        return "symbols"
    if n_words >= 3 and sum(map(len, _CAPITALS.findall(line))) > sum(map(len, _SMALL.findall(line))):
        return "capitals"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    n, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def long_counts(text: str) -> tuple[int, int]:
    """Words and repeat_words of a long text, in arrays: some 50 bytes a word instead of several hundred."""
    coded, _ = words_of(pa.array([text], pa.large_string()), lower=False)
    codes = np.asarray(coded.indices).astype(np.int64)
    if len(codes) < 3:
        return len(codes), 0
    _, pairs = np.unique(codes[:-1] * (int(codes.max()) + 1) + codes[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * (int(codes.max()) + 1) + codes[2:], return_inverse=True, return_counts=True)
    inside = np.zeros(len(codes), bool)
    twice = counts[which] > 1
    for k in range(3):
        inside[k : len(codes) - 2 + k] |= twice
    return len(codes), int(inside.sum())


def judge(text: str | None, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, failing lines by rule, cleaned text."""
    text = text or ""
    if len(text) > LONG_TEXT:
        n_words, n_repeat = long_counts(text)
    else:
        words = text.encode().split()
        n_words, n_repeat = len(words), repeat_words(words)
    n_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup, lost, faults, cleaned = 0, 0, Counter(), []
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            cleaned.append(line)
            continue
        n_dup += line in seen
        seen.add(line)
        if fault := line_fault(line, n, rules):
            faults[fault] += 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            cleaned.append(line)
    failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not failed and 100 * lost <= rules.max_lost_percent * n_chars
    return n_words, n_chars, n_symbols, n_dup, n_repeat, failed, kept, lost, dict(faults), "\n".join(cleaned)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, line_faults map<string,int>, cleaned string"
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.map_(pa.string(), pa.int32()), pa.string()]


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row for each row: id, counts, verdict, failing lines by rule and (with_text) what is left of the text."""
    kind = df.schema[id_col].dataType.simpleString()
    keep = 10 if with_text else 9
    fields = re.split(r", (?=\w+ )", SCHEMA)[:keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [judge(x, rules) for x in b.column("text").to_pylist()]
            columns = [pa.array([(list(r[i].items()) if i == 8 else r[i]) for r in out], _ARROW[i]) for i in range(keep)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", *(x.split()[0] for x in fields)])

    arrow_limits(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {', '.join(fields)}").withColumnRenamed("id", id_col)


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]


def op6_line_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return clean_lines(table(spark, sf_dir, "documents"), with_text=False).select(*RESULT)


_W = r"[^\x20\x09-\x0D]+"
_PHRASES = " OR ".join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_W}') AS ws FROM d),
windows AS (SELECT r, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS k FROM w, LATERAL unnest(range(1, len(ws) - 1)) AS u(i) WHERE len(ws) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
lines AS (SELECT r, pos, line, len(regexp_extract_all(line, '{_W}')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
judged AS (SELECT r, chars, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS dup,
  (NOT regexp_matches(line, '[.!?…。！？।؟۔"''”’»)\]」』）][\x09\x0B\x0C\x0D ]*$|[.!?…।؟۔] |[。！？]')
   OR (len(regexp_extract_all(line, '[|>»•·]')) >= 2 AND 4 * len(regexp_extract_all(line, '[|>»•·]')) >= n)
   OR n <= 30 AND ({_PHRASES})
   OR 2 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n
   OR (n >= 3 AND len(regexp_extract_all(line, '[A-Z]')) > len(regexp_extract_all(line, '[a-z]')))) AS fault
  FROM lines WHERE n > 0),
sums AS (SELECT r, count(*) FILTER (dup) AS dups, coalesce(sum(chars) FILTER (fault), 0) AS lost FROM judged GROUP BY r),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN sums USING (r) LEFT JOIN again USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 35 * word_chars AS kept FROM base
"""
