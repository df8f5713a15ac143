"""Scoring texts with a smoothed trigram model kept in Elias-Fano tries.

Tokens are words (A-Z in small letters) and one end for each text. With counts c of the training texts:
    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),  p(w | u) = (c(u, w) + mu p(w)) / (c(u) + mu),  p(w | t, u) = (c(t, u, w) + nu p(w | u)) / (c(t, u) + nu),
where a context that training lacks leaves all to the shorter one. Each context is a node of a trie: its weight left to the shorter context, mu / (c(u) + mu), and
the first summands of its successors are quantised there; scores are put together from what the tries give.

The corpus is read in slices of about SLICE bytes of text. Four passes:
1. Each slice sends the hashes and training counts of its distinct words to hash ranges, which add them up and answer each slice.
2. Each slice sends its distinct bigrams (32-bit prints) to shards by context; very frequent contexts are spread over several shards by successor.
   A shard builds its trie from the training counts of all slices, writes it to the shared folder, maps it into memory and looks up the bigrams of every slice.
3. The same for trigrams, their contexts being the bigrams.
4. Each slice puts the answers together into sums for its documents.
Answers are files in the shared folder, one for each slice; a task that runs again writes the same bytes. All passes must deal the same rows to the same
tasks in the same order, as scans of files do; a slice whose answer doesn't fit stops with an error.

Null and empty texts are one token, the end. Null ids are neither trained on nor held out. Repeated rows count each. With nothing to train on, V = N = 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, crc_mod, shared_dir, shuffles_dropped, slices, table
from folioscope.llm.elias_fano import Trie, restored
from folioscope.llm.shingles import mixed, words

SLICE = 6 << 20
#: Input bytes (as Spark estimates them) for each hash range or shard.
RANGE_BYTES = 2 << 20
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\n end"))
BEGIN_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\n begin"))


@dataclass(frozen=True)
class Plan:
    """What all tasks know: the folder, the number of ranges, the priors' masses and, after the first pass, N and V."""

    folder: str
    ranges: int
    mu: float = 3000.0
    nu: float = 30.0
    total: int = 0
    kinds: int = 0

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Smoothed probabilities of counts."""
        return (counts + 0.5) / (self.total + 0.5 * (self.kinds + 1))

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)

    def spread(self, counts: np.ndarray) -> np.ndarray:
        """Over how many shards a context of so many tokens is spread: no share is above half of a shard's mean."""
        return np.maximum(1, -(-2 * self.ranges * counts.astype(np.int64) // max(1, self.total)))


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _pack_ascending(a: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as steps, their bytes by place: the upper ones are nearly all alike."""
    return zstandard.compress(np.diff(a, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_ascending(b: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(_unpack(b, "u1").reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def put_file(folder: str, name: str, body: bytes) -> None:
    """Writes under another name, then renames."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    own = f"{base}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(body)
    system.move(own, f"{base}/{name}")


def get_file(folder: str, name: str) -> bytes:
    system, base = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        return f.read()


def mapped(folder: str, name: str) -> np.ndarray:
    """A file as bytes: mapped into memory where it is local, else read."""
    system, base = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", np.uint8, "r")
    return np.frombuffer(get_file(folder, name), np.uint8)


class Slice:
    """Distinct words of some documents, and the documents as codes of these."""

    def __init__(self, name: str, batches: list[pa.RecordBatch]):
        self.name = name
        self.ids = pa.chunked_array([b.column("id") for b in batches]).combine_chunks()
        self.held = pa.chunked_array([b.column("held") for b in batches]).combine_chunks()
        train = np.asarray(pa.chunked_array([b.column("train") for b in batches]).combine_chunks())
        coded, starts = words(pa.chunked_array([b.column("text") for b in batches]).combine_chunks())
        table = [xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()]
        self.end = len(table)
        #: hashes by code: words, the end, the beginning
        self.hashes = np.array([*table, END_HASH, BEGIN_HASH], np.uint64)
        n = np.diff(starts) + 1
        self.document = np.repeat(np.arange(len(n)), n)
        self.codes = np.empty(int(n.sum()), np.int64)
        last = np.cumsum(n) - 1
        inner = np.ones(len(self.codes), bool)
        inner[last] = False
        self.codes[inner] = np.asarray(coded.indices)
        self.codes[last] = self.end
        self.before = np.empty_like(self.codes)
        self.before[1:] = self.codes[:-1]
        self.before[last - n + 1] = self.end + 1
        self.trains = train[self.document]
        self.order = np.argsort(self.hashes[:-1])

    def word_counts(self) -> np.ndarray:
        """Training counts by code, the beginning left out."""
        return np.bincount(self.codes[self.trains], minlength=self.end + 1)

    def counts_from(self, answer: np.ndarray) -> np.ndarray:
        """Corpus counts by code (with the beginning, as often as the end) from the answer in order of hashes."""
        if len(answer) != len(self.order):
            raise RuntimeError("the passes were dealt different rows")
        out = np.empty(self.end + 2, np.int64)
        out[self.order] = answer
        out[self.end + 1] = out[self.end]
        return out

    def grouped(self, plan: Plan, context: np.ndarray, word: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> Grams:
        """Distinct (context, word) of the tokens given, sorted by shard and prints. context: numbers into hashes and counts; word: codes."""
        keys, inverse = np.unique(context * (self.end + 2) + word, return_inverse=True)
        own, successor = np.divmod(keys, self.end + 2)
        spread = plan.spread(counts)[own]
        with np.errstate(over="ignore"):
            home = mixed(hashes[own] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            prints = mixed(home)
            part = self.hashes[successor] % spread.astype(np.uint64)
            shard = plan.range_of(mixed(home + part * np.uint64(0x9E3779B97F4A7C15)))
        pair = (prints & np.uint64(0xFFFFFFFF)) << np.uint64(32) | (self.hashes[successor] & np.uint64(0xFFFFFFFF))
        order = np.argsort(pair)
        order = order[np.argsort(shard[order].astype(np.uint16 if plan.ranges <= 1 << 16 else np.int64), kind="stable")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Grams(shard[order], pair[order], own[order], successor[order], (spread > 1)[order], place[inverse.ravel()])

    def bigrams(self, plan: Plan, counts: np.ndarray) -> Grams:
        """Every token with the one before."""
        return self.grouped(plan, self.before, self.codes, self.hashes, counts)

    def trigrams(self, plan: Plan, two: Grams, counts: np.ndarray) -> tuple[Grams, np.ndarray]:
        """Tokens whose two tokens before are met in training, with that bigram (counts: of bigrams); and which tokens they are. The others have the weight 1."""
        context = np.zeros_like(two.token)
        context[1:] = two.token[:-1]
        chosen = np.flatnonzero((self.before != self.end + 1) & (counts[context] > 0))
        with np.errstate(over="ignore"):
            hashes = mixed(mixed(self.hashes[two.context]) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[two.word])
        return self.grouped(plan, context[chosen], self.codes[chosen], hashes, counts), chosen


@dataclass
class Grams:
    """Distinct n-grams in order of shard and prints: numbers of their contexts, codes of their words, whether the context is spread; token: the place of each token's."""

    shard: np.ndarray
    pair: np.ndarray
    context: np.ndarray
    word: np.ndarray
    wide: np.ndarray
    token: np.ndarray

    def runs(self) -> np.ndarray:
        """The number, in order, of each n-gram's context within its shard: the tries answer a weight for each."""
        if not len(self.pair):
            return np.zeros(0, np.int64)
        context = self.pair >> np.uint64(32)
        return np.concatenate([[0], np.cumsum((self.shard[1:] != self.shard[:-1]) | (context[1:] != context[:-1]))])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
    for b in slices(batches):
        held.append(b)
        n += b.column("text").nbytes
        if n >= SLICE:
            yield Slice(f"{part}-{number}", held)
            number, held, n = number + 1, [], 0
    if held:
        yield Slice(f"{part}-{number}", held)


def _write_answer(folder: str, kinds: dict[str, tuple[str, str]]) -> Callable[[pa.Table], pa.Table]:
    """For one slice: its ranges' answers in order, as a file for each column: {column: (file's kind, item)}."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("range")
        name, n = part.column("slice")[0].as_py(), 0
        for column, (kind, item) in kinds.items():
            whole = np.concatenate([_unpack(x, item) for x in part.column(column).to_pylist()])
            put_file(folder, f"{kind}-{name}", _pack(whole))
            n = len(whole)
        return pa.table({"slice": [name], "n": pa.array([n], pa.int64())})

    return run


def _word_pass(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            hashes, counts = s.hashes[:-1][s.order], s.word_counts()[s.order].astype(np.uint32)
            where = plan.range_of(hashes)
            cuts = np.searchsorted(where, np.arange(plan.ranges + 1))
            some = [r for r in range(plan.ranges) if cuts[r] < cuts[r + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([hashes[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()), pa.array([_pack(counts[cuts[r] : cuts[r + 1]]) for r in some], pa.binary())],
                ["slice", "range", "hashes", "counts"],
            )

    return run


def _word_range(part: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()]
    counts = np.concatenate([_unpack(x, "<u4") for x in part.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, counts).astype(np.uint64)
    answer = total[inverse]
    cuts = np.cumsum([0, *map(len, hashes)])
    n = part.num_rows
    sums = [int(total.sum())] + [0] * (n - 1)
    kinds = [int((total > 0).sum())] + [0] * (n - 1)
    return pa.table({"slice": part.column("slice"), "range": part.column("range"), "answer": pa.array([_pack(answer[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), "total": pa.array(sums, pa.int64()), "kinds": pa.array(kinds, pa.int64())})


GRAMS = "slice string, range int, contexts binary, sizes binary, words binary, counts binary, known binary"


def _sent(plan: Plan, name: str, g: Grams, met: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: its n-grams, their training counts here (met), and the whole counts of contexts that are spread."""
    context, word = (g.pair >> np.uint64(32)).astype(np.uint32), g.pair.astype(np.uint32)
    cuts = np.searchsorted(g.shard, np.arange(plan.ranges + 1))
    rows = []
    for r in range(plan.ranges):
        a, b = cuts[r], cuts[r + 1]
        if a == b:
            continue
        first = np.flatnonzero(np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]]))
        size = np.diff(np.concatenate([first, [b - a]])).astype(np.uint32)
        wide = first[g.wide[a:b][first]]
        # a context that is spread brings its whole count, others are added up in their shard
        known = np.stack([context[a:b][wide].astype(np.int64), counts[g.context[a:b][wide]]])
        rows.append((r, _pack_ascending(context[a:b][first]), _pack(size), word[a:b].tobytes(), _pack(met[a:b]), known.tobytes()))
    columns = [pa.array([name] * len(rows), pa.string()), pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[i] for x in rows], pa.binary()) for i in range(1, 6))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in GRAMS.split(", ")])


def _fitting(a: np.ndarray, n: int) -> np.ndarray:
    if len(a) != n:
        raise RuntimeError("the passes were dealt different rows")
    return a


def _counted(plan: Plan, s: Slice) -> tuple[np.ndarray, Grams]:
    counts = s.counts_from(_unpack(get_file(plan.folder, f"words-{s.name}"), "<u8"))
    return counts, s.bigrams(plan, counts)


def _pair_counts(plan: Plan, s: Slice, two: Grams) -> np.ndarray:
    return _fitting(_unpack(get_file(plan.folder, f"counts-{s.name}"), "<u4"), len(two.pair)).astype(np.int64)


def _bigram_pass(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            counts, two = _counted(plan, s)
            yield _sent(plan, s.name, two, np.bincount(two.token[s.trains], minlength=len(two.pair)).astype(np.uint32), counts)

    return run


def _trigram_pass(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            _, two = _counted(plan, s)
            counts = _pair_counts(plan, s, two)
            three, chosen = s.trigrams(plan, two, counts)
            yield _sent(plan, s.name, three, np.bincount(three.token[s.trains[chosen]], minlength=len(three.pair)).astype(np.uint32), counts)

    return run


def build_trie(pairs: np.ndarray, counts: np.ndarray, known: np.ndarray, mu: float) -> Trie:
    """From distinct pairs (context print << 32 | word print, ascending) with counts (0 only where a pair brings in its context); known: rows (context, whole count)."""
    context, word = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    _, code = np.unique(context, return_inverse=True)
    own = np.bincount(code, counts)
    if known.shape[1]:
        names, at = np.unique(known[0], return_index=True)
        each, first = np.unique(context, return_index=True)
        _, i, j = np.intersect1d(each.astype(np.int64), names, assume_unique=True, return_indices=True)
        own[i] = known[1][at][j]
    with np.errstate(divide="ignore"):
        log = np.log10(counts / (own[code] + mu)) if len(counts) else np.zeros(0)
    return Trie.of(context, word, log, np.log10(mu / (own + mu)))


ANSWERS = "slice string, range int, codes binary, counts binary, weights binary"


def _shard(plan: Plan, order: int):
    """Builds a shard's trie of bigrams or trigrams and answers every slice: codes and corpus counts of its n-grams, weights of its contexts."""
    prior = plan.mu if order == 2 else plan.nu

    def run(part: pa.Table) -> pa.Table:
        r = part.column("range")[0].as_py()
        pairs, starts = [], []
        for contexts, sizes, found in zip(*(part.column(x).to_pylist() for x in ("contexts", "sizes", "words")), strict=True):
            sizes = _unpack(sizes, "<u4")
            starts.append(np.cumsum(sizes) - sizes)
            pairs.append(np.repeat(_unpack_ascending(contexts), sizes).astype(np.uint64) << np.uint64(32) | np.frombuffer(found, np.uint32).astype(np.uint64))
        counts = np.concatenate([_unpack(x, "<u4") for x in part.column("counts").to_pylist()])
        known = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in part.column("known").to_pylist()], 1)
        distinct, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.bincount(inverse, counts)
        # a context that is spread may have no trained successor here, but has its weight
        seen = (total > 0) | np.isin(distinct >> np.uint64(32), known[0].astype(np.uint64))
        name = f"trie{order}-{r:08d}"
        put_file(plan.folder, name, build_trie(distinct[seen], total[seen], known, prior).to_bytes())
        trie = Trie.open(mapped(plan.folder, name))
        codes, weights = (x[inverse] for x in trie.find(distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF)))
        every = total[inverse].astype(np.uint32)
        cuts = np.cumsum([0, *map(len, pairs)])
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        packed = [pa.array([_pack(x[a:b]) for a, b in spans], pa.binary()) for x in (codes, every)]
        packed.append(pa.array([_pack(weights[a:b][first]) for (a, b), first in zip(spans, starts, strict=True)], pa.binary()))
        return pa.table([part.column("slice"), part.column("range"), *packed], names=["slice", "range", "codes", "counts", "weights"])

    return run


SCORES = "n_tokens long, n_known long, base_score double, score double"


def _score_pass(plan: Plan):
    def answer(s: Slice, g: Grams, order: str) -> tuple[np.ndarray, np.ndarray]:
        """The tries' answers for n-grams: their own summand and what their context leaves (1 where no trie has it)."""
        own = restored(_fitting(_unpack(get_file(plan.folder, f"{order}-{s.name}"), "u1"), len(g.pair)))
        runs = g.runs()
        weights = _fitting(_unpack(get_file(plan.folder, f"{order}-weights-{s.name}"), "u1"), int(runs[-1]) + 1 if len(runs) else 0)
        return own, np.where(weights == 0, 1.0, restored(weights))[runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            counts, two = _counted(plan, s)
            p = plan.unigram(counts)
            own, left = answer(s, two, "bigrams")
            model = (own + left * p[two.word])[two.token]
            pairs = _pair_counts(plan, s, two)
            three, chosen = s.trigrams(plan, two, pairs)
            if len(chosen):
                own, left = answer(s, three, "trigrams")
                model[chosen] = own[three.token] + left[three.token] * model[chosen]
            n = len(s.ids)
            sums = lambda x: np.bincount(s.document, x, n)  # noqa: B023, E731
            met = counts[s.codes]
            columns = [pa.array(np.bincount(s.document, minlength=n), pa.int64()), pa.array(sums(met > 0).astype(np.int64), pa.int64()), pa.array(sums(np.log10(p)[s.codes]), pa.float64()), pa.array(sums(np.log10(model)), pa.float64())]
            yield pa.RecordBatch.from_arrays([s.ids, s.held, *columns], ["id", "held", *(x.split()[0] for x in SCORES.split(", "))])

    return run


def score(df: DataFrame, train, held, id_col: str = "doc_id", text_col: str = "text", mu: float = 3000.0, nu: float = 30.0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; train and held: boolean columns."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    arrow_limits(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(held, F.lit(False)).alias("held"))
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    plan = Plan(f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}", int(min(1 << 20, max(64, estimate // RANGE_BYTES))), mu, nu)

    ranges = rows.mapInArrow(_word_pass(plan), "slice string, range int, hashes binary, counts binary").groupBy("range").applyInArrow(_word_range, "slice string, range int, answer binary, total long, kinds long")
    # totals come along with the answers, so that the counts are made once
    answers = ranges.groupBy("slice").applyInArrow(_word_answers(plan.folder), "slice string, total long, kinds long")
    with shuffles_dropped(spark):
        total, kinds = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    plan = Plan(plan.folder, plan.ranges, mu, nu, total, kinds)

    for order, sent, name, more in ((2, _bigram_pass, "bigrams", {"counts": ("counts", "<u4")}), (3, _trigram_pass, "trigrams", {})):
        answers = rows.mapInArrow(sent(plan), GRAMS).groupBy("range").applyInArrow(_shard(plan, order), ANSWERS)
        kinds = {"codes": (name, "u1"), "weights": (f"{name}-weights", "u1"), **more}
        written = answers.select("slice", "range", *kinds).groupBy("slice").applyInArrow(_write_answer(plan.folder, kinds), "slice string, n long")
        with shuffles_dropped(spark):
            written.agg(F.sum("n")).collect()

    out = rows.mapInArrow(_score_pass(plan), f"id {kind}, held boolean, {SCORES}")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _word_answers(folder: str) -> Callable[[pa.Table], pa.Table]:
    write = _write_answer(folder, {"answer": ("words", "<u8")})

    def run(part: pa.Table) -> pa.Table:
        done = write(part)
        return pa.table({"slice": done.column("slice"), "total": pa.array([pc.sum(part.column("total")).as_py()], pa.int64()), "kinds": pa.array([pc.sum(part.column("kinds")).as_py()], pa.int64())})

    return run


def op8_ngram_trie(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) mod 5 is 1 are held out."""
    crc = crc_mod("doc_id", 5)
    return score(table(spark, sf_dir, "documents"), crc != 1, crc == 1)
