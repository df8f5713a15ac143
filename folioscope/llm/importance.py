"""Importance resampling towards a target's distribution: hashed word features, a gain for each bucket, scores with Gumbel noise, the highest ones drawn.

Words are runs of letters and digits (anything beyond ASCII counts as such) after A-Z became small letters; features are single words and pairs of
neighbours, each in a bucket by its crc32. A bucket's gain is the logarithm of how much likelier the target is to have it than the input, in
thousandths; a row's weight is the floored mean of its features' gains. Adding Gumbel noise that depends on the id alone and keeping the highest
scores draws rows in proportion to their importance without replacement.

Rows never meet before they have a score: higher-order functions make a row's array of buckets, which is summed over a literal array of gains. Only
counts of buckets and, of the rows, ids with their numbers are shuffled.

Null and empty texts have no features and weight 0. A null id counts as the empty one in the noise and comes first among ties. Rows of one id and score are told
apart by features and weight, then dealt in any order. Repeated rows are rows of their own. Without target texts or input all gains come from the smoothing alone.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import stored, table
from folioscope.operators.longform import ranked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Draw:
    """percent of the rows with min_words words at least are drawn; seed starts the noise's hash; buckets of features."""

    percent: int = 25
    min_words: int = 20
    buckets: int = 10_000
    seed: int = 7


def features(text: Column, n_buckets: int) -> Column:
    """(n_words, buckets): the bucket of every word and of every pair of neighbours."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))

    def bucket(x: Column) -> Column:
        return (F.crc32(x.cast("binary")) % n_buckets).cast("int")

    def made(ws: Column) -> Column:
        firsts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0)))
        both = F.transform(firsts, lambda w, i: bucket(F.concat(w, F.lit(" "), F.get(ws, i + 1))))
        return F.struct(F.size(ws).alias("n_words"), F.concat(F.transform(ws, bucket), both).alias("buckets"))

    return F.transform(F.array(words), made)[0]  # an array of one: the words are found once, not for each use


def counts(df: DataFrame, text_col: str, n_buckets: int) -> DataFrame:
    """(bucket, n): of all features; each task sends its totals only."""
    return df.select(F.explode(features(F.col(text_col), n_buckets)["buckets"]).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(df: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", n_buckets: int = 10_000) -> list[int]:
    """Each bucket's gain in thousandths: as many numbers as there are buckets come to the driver, whatever the input."""
    all_, wanted = counts(df, text_col, n_buckets), counts(target, target_col, n_buckets)
    both = all_.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(wanted.select("bucket", F.lit(0).cast("long"), "n"))
    rows = df.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")).union(both)
    sums = rows.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = Window.partitionBy()  # a row for each bucket
    out = sums.select("bucket", F.floor(F.lit(1000.0) * F.log(((F.col("t") + 1) * (F.sum("s").over(total) + n_buckets)) / ((F.col("s") + 1) * (F.sum("t").over(total) + n_buckets)))).alias("gain"))
    return [r["gain"] for r in out.orderBy("bucket").collect()]


def scores(df: DataFrame, gain: list[int], id_col: str, text_col: str, draw: Draw) -> DataFrame:
    """df with __n_words, __n_features, __weight and __score, without a shuffle."""
    table_of_gains = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into a literal before it runs

    def summed(f: Column) -> Column:
        n = F.size(f["buckets"]).cast("long")
        total = F.aggregate(f["buckets"], F.lit(0).cast("long"), lambda a, b: a + F.element_at(table_of_gains, b + 1))
        return F.struct(f["n_words"].alias("n_words"), n.alias("n"), total.alias("total"))

    f = F.transform(F.array(features(F.col(text_col), draw.buckets)), summed)[0]
    n, total = F.col("__f.n"), F.col("__f.total")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    weight = F.when(n > 0, F.expr("(__f.total - pmod(__f.total, __f.n)) div __f.n")).otherwise(F.lit(0).cast("long"))
    rows = df.withColumn("__f", f)
    return rows.withColumns({"__n_words": F.col("__f.n_words"), "__n_features": n, "__weight": weight}).withColumn("__score", F.col("__weight") + gumbel).drop("__f")


def _cut(scored: DataFrame, draw: Draw) -> tuple[int, int | None, int]:
    """How many are drawn, the least score of a drawn row (None if none is), and how many stand above it. Scores are whole numbers within some tens of thousands."""
    hist = scored.where(F.col("__n_words") >= draw.min_words).groupBy("__score").agg(F.count("*").alias("k"))
    quota = draw.percent * (hist.agg(F.sum("k")).first()[0] or 0) // 100
    above = F.sum("k").over(Window.orderBy(F.desc("__score")))  # a row for each distinct score
    last = hist.select("__score", "k", above.alias("to")).where(F.col("to") >= quota).orderBy(F.desc("__score")).first() if quota else None
    return (quota, last["__score"], last["to"] - last["k"]) if last else (0, None, 0)


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", draw: Draw = Draw()) -> DataFrame:
    """For each row of df: id, n_features, weight, score, and the place of its score among all (from 1) where it is drawn."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = scores(rows, gains(rows, target, "text", target_col, draw.buckets), "id", "text", draw).drop("text")
    scored = stored(spark, scored.withColumn("__salt", F.monotonically_increasing_id()), "importance-scores")
    quota, least, _ = _cut(scored, draw)
    names = [F.col("id").alias(id_col), F.col("__n_features").alias("n_features"), F.col("__weight").alias("weight"), F.col("__score").alias("score")]
    if least is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    high = (F.col("__n_words") >= draw.min_words) & (F.col("__score") >= least)
    # one distributed sort of what may be drawn
    first = ranked(scored.where(high), "__score", ["id", "__n_features", "__weight", "__salt"], "__rank")
    rank = F.when(F.col("__rank") <= quota, F.col("__rank"))
    return first.select(*names, rank.cast("long").alias("rank")).union(scored.where(~high).select(*names, F.lit(None).cast("long")))


def drawn(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", draw: Draw = Draw()) -> DataFrame:
    """The drawn rows of df with all their columns. Rows above the least drawn score pass as they are read; only those that have it are sorted."""
    spark, places = df.sparkSession, [f"_{i}" for i in range(len(df.columns))]
    ident, text = places[df.columns.index(id_col)], places[df.columns.index(text_col)]
    rows = df.toDF(*places)
    made = scores(rows, gains(rows, target, text, target_col, draw.buckets), ident, text, draw)
    quota, least, above = _cut(stored(spark, made.select("__n_words", "__score"), "importance-scores"), draw)
    if least is None:
        return df.limit(0)
    made = made.where(F.col("__n_words") >= draw.min_words)
    tied = ranked(made.where(F.col("__score") == least), "__score", [ident, "__n_features", "__weight"], "__rank").where(F.col("__rank") <= quota - above)
    return made.where(F.col("__score") > least).select(*places).union(tied.select(*places)).toDF(*df.columns)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Weight, score and place of every document, the benchmark's texts being the target."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def crc32_sql(text: str, table_name: str = "crc.t") -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes; FROM needs CRC_TABLE as crc."""
    hexed = f"hex(encode({text}))"
    number = f"list_transform(range(0, len({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({number}, lambda a, x: xor(a >> 8, {table_name}[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


CRC_TABLE = """(SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i::BIGINT) AS v FROM range(0, 256) AS r(i)))"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH crc AS MATERIALIZED (SELECT t FROM {CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
fd AS MATERIALIZED (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
fb AS MATERIALIZED (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
dist AS (SELECT f FROM fd UNION SELECT f FROM fb),
buckets AS MATERIALIZED (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM dist, crc),
s AS (SELECT bucket, count(*)::DOUBLE AS n FROM fd JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS n FROM fb JOIN buckets USING (f) GROUP BY bucket),
gain AS (SELECT i AS bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g
  FROM range(0, 10000) AS a(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
w AS (SELECT r, count(*)::BIGINT AS n, sum(g)::BIGINT AS total FROM fd JOIN buckets USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN w USING (r)),
ranks AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n_all FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n_all // 100 THEN place END::BIGINT AS rank FROM ranks
"""
