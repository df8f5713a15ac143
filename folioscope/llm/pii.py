"""Personal data by bootstrapped contextual extraction.

1. One scan of every whole text finds seed entities (strict patterns: email, ip, card, phone) and candidates: looser shapes of the same kinds.
   The one and the two words before each are its lexical patterns.
2. Spark scores the graph of patterns and instances in rounds. A pattern's confidence is the summed score of its distinct instances, divided by their
   number plus the ordinary words that follow the same words in the same documents; an instance that is no seed scores the mean of its patterns.
   What an accepted pattern finds supports further patterns in the next round, worth a little less in each, so that drift dies out.
3. Candidates after a pattern of high confidence and with enough support are new identifiers.
Words and instances are taken whole, long ones by their hash.

Seed spans are never dropped. Null and empty texts have no spans. Each input row gives one row, repeated ids and null ids too.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, slices, stored, table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser shapes: an at sign or its spelling between words, four to eight groups with colons, a run of 7 to 19 digits with separators.
_AT = re.compile(r"@|\(at\)|\[at\]")
_AFTER_AT = re.compile(r" ?[A-Za-z0-9][A-Za-z0-9.-]*")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
_RUN = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
_WORD = re.compile(r"\S+")
#: Longer words and instances go by their hash.
_LONGEST_NAME = 64


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(map(int, digits[::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time: from each at sign to the left, then to the right."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of at most 255 with dots between; a longer row of numbers is taken in fours."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield at, at + size
            at += size + 1


def seeds(text: str) -> list[tuple[int, int, str]]:
    """Spans of the strict patterns, by start and then by kind as listed."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(s, e, 1) for s, e in addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Looser shapes that overlap no seed and none before them."""
    found = []
    for m in _AT.finditer(text):
        end = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        start = end
        while start and text[start - 1] in _LOCAL:
            start -= 1
        right = _AFTER_AT.match(text, m.end())
        if start < end and right:
            found.append((start, right.end(), "email"))
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _COLONS.finditer(text)]
        for m in _RUN.finditer(text):
            n = len(_DIGIT.findall(m[0]))
            found.append((*m.span(), "phone" if n < 12 else "card"))
    spans = sorted((s, e) for s, e, _ in taken)
    starts, last, longest = [s for s, _ in spans], 0, []
    for _, e in spans:
        longest.append(max(e, longest[-1]) if longest else e)
    out = []
    for s, e, kind in sorted(found):
        k = bisect_right(starts, e - 1)
        if s >= last and not (k and longest[k - 1] > s):
            out.append((s, e, kind))
            last = e
    return out


class Name:
    """A word or an instance in small letters (with digits=True as it is, else with 0 for each digit), long ones as their hash; it can grow."""

    def __init__(self, digits: bool = False):
        self.digits, self.head, self.n, self.hash = digits, "", 0, hashlib.blake2b(digest_size=16)

    def add(self, part: str) -> Name:
        part = (part if self.digits else _DIGIT.sub("0", part)).lower()
        self.n += len(part)
        self.head += part[: _LONGEST_NAME + 1 - len(self.head)]
        self.hash.update(part.encode())
        return self

    def __str__(self) -> str:
        return self.head if self.n <= _LONGEST_NAME else "~" + self.hash.hexdigest()


def contexts(text: str, places: list[int]) -> dict[int, list[str]]:
    """For each place (ascending) the one and the two words before it; a word that goes on beyond the place is cut there. In one pass, linear in the text."""
    out: dict[int, list[str]] = {}
    whole: list[str] = []

    def said(words: list[str]) -> list[str]:
        return [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]

    before: list[tuple[int, int]] = []
    i = 0
    for m in _WORD.finditer(text):
        s, e = m.span()
        if i < len(places) and places[i] < e:
            whole = [str(Name().add(text[a:b])) for a, b in before]
            while i < len(places) and places[i] <= s:
                out[places[i]] = said(whole)
                i += 1
            part, at = Name(), s
            while i < len(places) and places[i] < e:
                part.add(text[at : places[i]])
                at = places[i]
                out[at] = said([*whole, str(part)])
                i += 1
        if i == len(places):
            return out
        before = [*before[-1:], (s, e)]
    whole = [str(Name().add(text[a:b])) for a, b in before]
    return out | {p: said(whole) for p in places[i:]}


def ordinary(text: str, wanted: Counter) -> Counter:
    """How often the contexts occur in a text beyond the times given."""
    seen, last = Counter(), ""
    for m in _WORD.finditer(_DIGIT.sub("0", text).lower()):
        word = m[0] if m.end() - m.start() <= _LONGEST_NAME else str(Name().add(m[0]))
        if word in wanted:
            seen[word] += 1
        if (both := f"{last} {word}") in wanted:
            seen[both] += 1
        last = word
    return Counter({x: max(0, seen[x] - n) for x, n in wanted.items()})


SCAN = "uid string, seeds array<struct<s:int,e:int,kind:string>>, candidates array<struct<s:int,e:int,kind:string,contexts:array<string>>>, edges array<struct<context:string,kind:string,instance:string,seed:boolean,other:int>>"
_SPAN = [("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]
_ARROW = [
    pa.string(),
    pa.list_(pa.struct(_SPAN)),
    pa.list_(pa.struct([*_SPAN, ("contexts", pa.list_(pa.string()))])),
    pa.list_(pa.struct([("context", pa.string()), ("kind", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()), ("other", pa.int32())])),
]


def scan_text(text: str | None) -> tuple[list, list, list]:
    """Seeds, candidates with their contexts, and edges (context, instance) of one text."""
    if not text or not ("@" in text or _DIGIT.search(text) or "(at)" in text or "[at]" in text):
        return [], [], []
    strict = seeds(text)
    loose = candidates(text, strict)
    if not strict and not loose:
        return [], [], []
    near = contexts(text, sorted({s for s, _, _ in [*strict, *loose]}))
    around = {(s, e, k): near[s] for s, e, k in [*strict, *loose]}
    rest = ordinary(text, Counter(c for x in around.values() for c in x))
    edges, told = [], set()
    for spans, seed in ((strict, True), (loose, False)):
        for s, e, k in spans:
            for c in around[s, e, k]:
                # ordinary words count once for each context, kind and document
                edges.append({"context": c, "kind": k, "instance": str(Name(True).add(text[s:e])), "seed": seed, "other": 0 if (c, k) in told else rest[c]})
                told.add((c, k))
    return (
        [{"s": s, "e": e, "kind": k} for s, e, k in strict],
        [{"s": s, "e": e, "kind": k, "contexts": around[s, e, k]} for s, e, k in loose],
        edges,
    )


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; confidence and support that a pattern must have to find new identifiers; decay: what a found identifier is worth of the patterns that found it."""

    rounds: int = 4
    confidence: float = 0.8
    support: int = 3
    decay: float = 0.95


def score_patterns(edges: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(kind, context, confidence, support, accepted) of every pattern; edges: context, kind, instance, seed, other.
    In each round a pattern's confidence is the summed score of its distinct instances, divided by their number plus the ordinary words in its place; its support is how many
    of these are seeds or were found. A pattern with enough of both is accepted and finds its instances: these then score decay times the greatest confidence of
    such a pattern and support others. Instances that are neither score the mean confidence of their patterns."""
    spark = edges.sparkSession
    graph = stored(spark, edges.groupBy("kind", "context", "instance").agg(F.max("seed").alias("seed"), F.sum("other").alias("other")), "pii-graph")
    links = graph.select("kind", "context", "instance")
    size = graph.groupBy("kind", "context").agg((F.count("*") + F.sum("other")).alias("size"))
    instances = graph.groupBy("kind", "instance").agg(F.max("seed").alias("seed")).select("kind", "instance", "seed", F.col("seed").cast("double").alias("score"), F.col("seed").alias("known"))
    patterns = None
    for left in range(how.rounds, 0, -1):
        mass = links.join(instances, ["kind", "instance"]).groupBy("kind", "context").agg(F.sum("score").alias("mass"), F.count_if("known").alias("support"))
        confidence = F.col("mass") / F.col("size")
        ok = (confidence >= how.confidence) & (F.col("support") >= how.support)
        patterns = stored(spark, size.join(mass, ["kind", "context"]).select("kind", "context", "support", confidence.alias("confidence"), ok.alias("accepted")), "pii-patterns")
        if left > 1:
            means = links.join(patterns, ["kind", "context"]).groupBy("kind", "instance").agg(F.avg("confidence").alias("mean"), F.max("accepted").alias("found"), F.max(F.when(F.col("accepted"), F.col("confidence"))).alias("best"))
            score = F.when(F.col("seed"), 1.0).when(F.col("found"), how.decay * F.col("best")).otherwise(F.col("mean"))
            instances = stored(spark, instances.join(means, ["kind", "instance"]).select("kind", "instance", "seed", score.alias("score"), (F.col("seed") | F.col("found")).alias("known")), "pii-instances")
    return patterns


def scan(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """_0, _1, ... (id and carried columns) with what the scan of each text finds."""
    kept = {name: df.schema[name].dataType.simpleString() for name in [id_col, *carry]}
    names = [f"_{i}" for i in range(len(kept))]
    text = names[[*kept].index(text_col)] if kept.get(text_col) == "string" else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in slices(batches, text):
            out = [(f"{part}-{n + i}", *scan_text(x)) for i, x in enumerate(b.column(text).to_pylist())]
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *(pa.array([r[i] for r in out], k) for i, k in enumerate(_ARROW))], [*names, "uid", "seeds", "candidates", "edges"])

    arrow_limits(df.sparkSession)
    more = [F.col(text_col).cast("string").alias("_text")] if text == "_text" else []
    rows = df.select(*(F.col(f"`{name}`").alias(x) for x, name in zip(names, kept, strict=True)), *more)
    return rows.mapInArrow(run, ", ".join([*(f"{x} {k}" for x, k in zip(names, kept.values(), strict=True)), SCAN]))


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """Each row's id with seeds (the strict spans) and found (new ones): arrays of (s, e, kind)."""
    return _extracted(df, id_col, text_col, [], how).select(F.col("_0").alias(id_col), "seeds", "found")


def _extracted(df: DataFrame, id_col: str, text_col: str, carry: list[str], how: Bootstrap) -> DataFrame:
    """_0, _1, ... (id and carried columns), seeds and found of each row."""
    spark = df.sparkSession
    scanned = stored(spark, scan(df, id_col, text_col, carry), "pii-scan")
    edges = scanned.select(F.explode("edges").alias("x")).select("x.*")
    good = score_patterns(edges, how).where("accepted").select("kind", "context")
    loose = scanned.select("uid", F.explode("candidates").alias("x")).select("uid", "x.s", "x.e", "x.kind", F.explode("x.contexts").alias("context"))
    hits = loose.join(good, ["kind", "context"]).select("uid", F.struct("s", "e", "kind").alias("span"))
    # written first: its true size then decides between broadcast and shuffle below
    found = stored(spark, hits.groupBy("uid").agg(F.array_sort(F.collect_set("span")).alias("found")), "pii-found")
    names = [f"_{i}" for i in range(len(carry) + 1)]
    none = F.array().cast("array<struct<s:int,e:int,kind:string>>")
    return scanned.join(found, "uid", "left").select(*names, "seeds", F.coalesce("found", none).alias("found"))


def _order(kind):
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def span_text(spans):
    """kind:start:end, by start and then kind as listed, comma-joined."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), _order(x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def masked_text(text: str | None, spans: list) -> str | None:
    """The text with each span (merged where they overlap) replaced by its kind in brackets."""
    if text is None or not spans:
        return text
    out, end = [], 0
    for s, e, kind in sorted(spans):
        if e <= end:
            continue
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = e
    return "".join([*out, text[end:]])


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """df with every found span masked in its text; all rows and columns stay."""
    if df.schema[text_col].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} must be a string column")
    columns = [id_col, *(c for c in df.columns if c != id_col)]
    names = [f"_{i}" for i in range(len(columns))]
    found = _extracted(df, id_col, text_col, columns[1:], how)
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans").to_pylist()
            new = [masked_text(t, [(x["s"], x["e"], x["kind"]) for x in v or []]) for t, v in zip(b.column(place).to_pylist(), spans, strict=True)]
            yield b.set_column(place, names[place], pa.array(new, pa.string())).drop_columns(["spans"])

    schema = ", ".join(f"{x} {df.schema[c].dataType.simpleString()}" for x, c in zip(names, columns, strict=True))
    out = found.select(*names, F.concat("seeds", "found").alias("spans")).mapInArrow(run, schema).toDF(*columns)
    return out.select(*(f"`{c}`" for c in df.columns))


def op10_contextual_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    rows = extract(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(seeds, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(span_text(F.col("seeds")), 256).alias("base_sha256"), span_text(F.concat("seeds", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"))
