"""Mixing sources by temperature: token shares to a power, found by bisection, become budgets that are met by permuted blocks.

1. Each row goes to one of 16 ** digits blocks of its source, by the md5 of its id and text; tokens are counted for each block.
2. Weights are shares ** exponent, normalised. The largest exponent (the least change) whose weights reach a target entropy is bisected; a repetition
   limit bounds it from below: no source may be repeated more often than that.
3. A source's budget is its weight of the total. It is met in epochs: each takes the source's blocks in an order of its own (by md5 of seed, epoch,
   source and block) until the budget is spent; the block in which it is spent is cut between rows, in an order of the same kind.

Tokens are runs of characters other than space and \\t to \\r. Null texts have none. A null source is a source of its own. Rows without tokens come
with their blocks. Repeated rows are rows of their own (in one block). Null ids count as empty ones. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: More sources than this are refused: the driver holds a number for each.
MOST_SOURCES = 100_000
#: Plans of more rows are joined by shuffle, others are broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Target:
    """entropy: share of the greatest possible entropy that weights must reach; repetition: most epochs of a source.
    budget: tokens in all; None for the least that leaves no row out; -1 for as many as there are. digits: of a block's name, from the input's size if None."""

    entropy: float | None = None
    repetition: float | None = None
    budget: int | None = None
    digits: int | None = None
    seed: str = "mix"


def weights(sizes: list[int], exponent: float) -> list[float]:
    """Normalised powers of the shares; sources without tokens have weight 0."""
    total = sum(sizes)
    powers = [(n / total) ** exponent if n else 0.0 for n in sizes]
    return [p / math.fsum(powers) for p in powers] if total else [0.0 for _ in sizes]


def entropy(p: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in p if x)


def repetitions(sizes: list[int], p: list[float], budget: int | None) -> float:
    """Epochs of the most repeated source."""
    each = [w / n for w, n in zip(p, sizes, strict=True) if n]
    total = budget if budget is not None else 1 / min(each)
    return total * max(each)


def exponent(sizes: list[int], target: Target, rounds: int = 50) -> float:
    """Bisects in [0, 1]."""
    some = [n for n in sizes if n]
    if len(some) < 2:
        return 1.0
    alpha = 1.0
    if target.entropy is not None:
        wanted = target.entropy * math.log(len(some))
        low, high = 0.0, 1.0
        if entropy(weights(some, 1.0)) < wanted:
            for _ in range(rounds):
                mid = (low + high) / 2
                low, high = (mid, high) if entropy(weights(some, mid)) >= wanted else (low, mid)
            alpha = low
    if target.repetition is not None and repetitions(some, weights(some, alpha), target.budget) > target.repetition:
        low, high = alpha, 1.0
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (low, mid) if repetitions(some, weights(some, mid), target.budget) <= target.repetition else (mid, high)
        alpha = high
    return alpha


def budgets(sizes: list[int], target: Target) -> list[int]:
    """Tokens of each source."""
    p = weights(sizes, exponent(sizes, target))
    if target.budget is not None:
        return [int(math.floor(target.budget * w + 0.5)) for w in p]
    most = max((n / w for n, w in zip(sizes, p, strict=True) if n), default=0.0)
    return [max(n, int(math.floor(most * w + 0.5))) for n, w in zip(sizes, p, strict=True)]


def block_digits(n_bytes: int) -> int:
    """Hex digits of a block's name by the input's size (as Spark estimates it): 3 up to 16 GB, 4 up to 256 GB, then 5. A source's blocks (a million at most) are
    ordered by one task for each epoch, and rows of one block by another: 33 MB of a source of 33 TB."""
    return 3 + (n_bytes > 16 << 30) + (n_bytes > 256 << 30)


def mix(df: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", marks: bool = True) -> DataFrame:
    """df's rows as often as the budgets ask; with marks also _n_tokens, _epoch (from 0) and _position (their block's place in that epoch of the source), which df mustn't have."""
    spark = df.sparkSession
    made = ["_n_tokens", "_epoch", "_position"] if marks else []
    if clash := set(made) & set(df.columns):
        raise ValueError(f"columns of these names would be made: {', '.join(sorted(clash))}")
    digits = target.digits or block_digits(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # the input's columns go by place, so that none can clash with those made here
    places = [f"_{i}" for i in range(len(df.columns))]
    own, text, group = (F.col(places[df.columns.index(c)]) for c in (id_col, text_col, source_col))
    text = text.cast("string")
    source = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("null"))
    # with the text's hash, rows of one id (or none) spread over blocks
    ident = F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    rows = df.toDF(*places).withColumns({"__source": source, "__n": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "__block": F.substring(F.md5(ident.cast("binary")), 1, digits)})
    blocks = stored(spark, rows.groupBy("__source", "__block").agg(F.sum("__n").alias("__tokens")), "mixing-blocks")
    sizes = [(r[0], r[1]) for r in blocks.groupBy("__source").agg(F.sum("__tokens").alias("n")).orderBy("__source").limit(MOST_SOURCES + 1).collect()]
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = [n for _, n in sizes]
    spent = budgets(total, target if target.budget != -1 else replace(target, budget=sum(total)))
    parts = [(s, b // n if n else 0, b % n if n else 0) for (s, n), b in zip(sizes, spent, strict=True)]
    # a plain join: Spark sees the size of these rows and broadcasts them where they are few
    epochs = spark.createDataFrame(parts, "__source string, __full long, __rest long").withColumn("__epoch", F.explode(F.expr("sequence(0, greatest(0, cast(__full as int) - if(__rest = 0 AND __full > 0, 1, 0)))")))
    deal = blocks.join(epochs, "__source")
    key = F.md5(F.concat_ws(":", F.lit(target.seed), "__epoch", "__source", "__block").cast("binary"))
    order = Window.partitionBy("__source", "__epoch").orderBy(key, "__block")
    before = F.coalesce(F.sum("__tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deal = deal.withColumns({"__position": F.row_number().over(order), "__room": F.col("__rest") - before})
    whole = (F.col("__epoch") < F.col("__full")) | (F.col("__room") >= F.col("__tokens"))
    deal = deal.withColumn("__whole", whole).where("__whole OR __room > 0").select("__source", "__block", "__epoch", "__position", "__room", "__whole")
    deal = stored(spark, deal, "mixing-plan")
    n_whole, n_cut = (deal.where(f"__whole = {x}").count() for x in ("true", "false"))
    few = (lambda x: F.broadcast(x)) if n_whole <= BROADCAST_ROWS and n_cut <= BROADCAST_ROWS else (lambda x: x)
    taken = rows.join(few(deal.where("__whole")), ["__source", "__block"])
    # of cut blocks (one a source at most) rows are taken while the room isn't filled: the last one may go beyond it
    cut = rows.join(few(deal.where("NOT __whole")), ["__source", "__block"])
    plain = [F.col(x) for x, f in zip(places, df.schema, strict=True) if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    ranked = Window.partitionBy("__source", "__block", "__epoch").orderBy(F.md5(F.concat_ws(":", F.lit(target.seed), "__epoch", ident).cast("binary")), "__n", F.xxhash64(*plain)).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__before", F.coalesce(F.sum("__n").over(ranked), F.lit(0))).where("__before < __room")
    names = [*places, *(["__n", "__epoch", "__position"] if marks else [])]
    return taken.select(*names).union(cut.select(*names)).toDF(*df.columns, *made)


def op1_temperature_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to 95 % of the greatest entropy, at most 4 epochs of a source, with as many tokens as there are."""
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, Target(entropy=0.95, repetition=4.0, budget=-1))
    return out.select("doc_id", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_epoch").cast("long").alias("epoch"), F.col("_position").cast("long").alias("position"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS ident, substr(md5(ident), 1, 3) AS b FROM documents),
blocks AS (SELECT s, b, sum(n)::BIGINT AS n FROM t GROUP BY s, b),
sizes AS (SELECT s, sum(n)::BIGINT AS n, sum(n) / (SELECT sum(n) FROM t)::DOUBLE AS share FROM blocks GROUP BY s),
mids AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT k + 1, CASE WHEN h >= w THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= w THEN hi ELSE (lo + hi) / 2 END FROM
  (SELECT k, lo, hi, (SELECT 0.95 * ln(count(*)) FROM sizes WHERE n > 0) AS w,
    (SELECT ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ln(pow(share, (lo + hi) / 2))) / sum(pow(share, (lo + hi) / 2)) FROM sizes WHERE n > 0) AS h FROM mids WHERE k < 50)),
alpha AS (SELECT CASE WHEN (SELECT -sum(share * ln(share)) >= 0.95 * ln(count(*)) FROM sizes WHERE n > 0) THEN 1.0 ELSE (SELECT lo FROM mids WHERE k = 50) END AS a),
spent AS (SELECT s, n, floor((SELECT sum(n) FROM t) * pow(share, a) / (SELECT sum(pow(share, a)) FROM sizes WHERE n > 0) + 0.5)::BIGINT AS budget FROM sizes, alpha),
parts AS (SELECT s, budget // n AS f, budget % n AS r FROM spent WHERE n > 0),
epochs AS (SELECT s, f, r, unnest(range(0, greatest(1, f + CASE WHEN r = 0 THEN 0 ELSE 1 END))) AS e FROM parts),
deal AS (SELECT s, b, n, e, f, r, row_number() OVER o AS pos, r - coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM blocks JOIN epochs USING (s) WINDOW o AS (PARTITION BY s, e ORDER BY md5('mix:' || e || ':' || s || ':' || b), b)),
rows_ AS (SELECT t.doc_id, t.source, t.n, d.e, d.pos, d.room, (d.e < d.f OR d.room >= d.n) AS whole,
  coalesce(sum(t.n) OVER (PARTITION BY t.s, t.b, d.e ORDER BY md5('mix:' || d.e || ':' || t.ident), t.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM t JOIN deal d ON t.s = d.s AND t.b = d.b WHERE d.e < d.f OR d.room >= d.n OR d.room > 0)
SELECT doc_id, source, n AS n_tokens, e::BIGINT AS epoch, pos::BIGINT AS position FROM rows_ WHERE whole OR bef < room
"""
