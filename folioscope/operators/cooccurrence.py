"""Co-occurrence, coupling and collaboration. Pairs are made inside rows or by a join on the shared item; margins are passed along explicitly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.longform import cut, list_column, long, pairs

#: Documents of an item beyond which coupling tries to do without its pairs.
POPULAR = 1000


def cooccurrence(df: DataFrame, column: str, top_n: int | None = None, min_count: int = 1) -> DataFrame:
    """(a, b, n) of distinct items of a document, a < b; among the top_n items if given."""
    if top_n:
        rows = long(df, column)
        top = rows.groupBy("item").count().orderBy(F.desc("count"), "item").limit(top_n)  # top_n rows
        kept = rows.join(F.broadcast(top.select("item")), "item", "left_semi").groupBy("doc_id").agg(F.collect_set("item").alias(column))
        df = kept
    return pairs(df, column).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def normalised(edges: DataFrame, margins: DataFrame) -> DataFrame:
    """Adds association (n / sqrt(na nb)), inclusion, jaccard and equivalence; margins: (item, k)."""
    a = margins.select(F.col("item").alias("a"), F.col("k").alias("ka"))
    b = margins.select(F.col("item").alias("b"), F.col("k").alias("kb"))
    n, ka, kb = F.col("n"), F.col("ka"), F.col("kb")
    return edges.join(a, "a").join(b, "b").withColumns({"association": n / F.sqrt(ka * kb), "inclusion": n / F.least(ka, kb), "jaccard": n / (ka + kb - n), "equivalence": n * n / (ka * kb)}).drop("ka", "kb")


def margins(df: DataFrame, column: str) -> DataFrame:
    """(item, k): documents of each item."""
    return long(df, column).groupBy("item").agg(F.count("*").alias("k"))


def coupling(df: DataFrame, column: str, at_least: int = 1) -> DataFrame:
    """(a, b, n): documents that share n items, at_least or more, a < b. Items of one document only are dropped before the join.

    From two shared items on, documents meet on pairs of items where their lists make fewer of these than items make pairs of documents: n items are n (n - 1) / 2 pairs, so
    what meets is a result. Else: documents that share at_least items share one that isn't among the at_least - 1 commonest of either. Where items of more than POPULAR
    documents would make half of the pairs or more, each document's commonest are left out of the join and what is shared is counted on the lists of the pairs found; else
    all pairs are added up."""
    rows = long(df, column)
    shared = rows.groupBy("item").agg(F.count("*").alias("k")).where("k > 1")
    rows = rows.join(shared, "item")

    def added(rows: DataFrame) -> DataFrame:
        other = rows.select("item", F.col("doc_id").alias("b"))
        return rows.select("item", F.col("doc_id").alias("a")).join(other, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)

    if at_least < 2:
        return added(rows)
    squares = F.col("k").cast("double") * F.col("k")
    every, popular, n = shared.agg(F.sum(squares), F.sum(F.when(F.col("k") > POPULAR, squares)), F.sum("k")).first()
    size = F.size(F.array_distinct(list_column(df, column))).cast("double")
    if every and (df.agg(F.sum(F.when(size > 1, size * (size - 1)))).first()[0] or 0.0) <= every - n:
        return _by_item_pairs(rows, at_least)
    if (popular or 0.0) < (every or 0.0) / 2 or not every:
        return added(rows)
    # each document's shared items, the rarest first
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("l")).where(F.size("l") >= at_least)
    lists = lists.select("doc_id", F.transform("l", lambda x: x["item"]).alias("items"))
    rare = lists.select("doc_id", F.explode(F.slice("items", F.lit(1), F.size("items") - (at_least - 1))).alias("item"))
    pairs = rare.select("item", F.col("doc_id").alias("a")).join(rare.select("item", F.col("doc_id").alias("b")), "item").where("a < b").select("a", "b").distinct()
    both = pairs.join(lists.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(lists.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n")).where(F.col("n") >= at_least)


def _by_item_pairs(rows: DataFrame, at_least: int) -> DataFrame:
    """(a, b, n) of rows (doc_id, item): documents joined on pairs of items, of which n shared items make n (n - 1) / 2."""
    two = pairs(rows.groupBy("doc_id").agg(F.collect_list("item").alias("items")), "items").select("doc_id", F.col("a").alias("x"), F.col("b").alias("y"))
    met = two.select("x", "y", F.col("doc_id").alias("a")).join(two.select("x", "y", F.col("doc_id").alias("b")), ["x", "y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return met.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("n")).where(F.col("n") >= at_least)


def between(df: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b, n): documents that have item a in one list and b in the other. Pairs are made inside the row."""
    both = F.flatten(F.transform(F.array_distinct(left), lambda x: F.transform(F.array_distinct(right), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return df.select("doc_id", F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def country_links(df: DataFrame, column: str = "countries", min_weight: int = 1) -> DataFrame:
    """Country pairs with weight and Jaccard index."""
    return normalised(cooccurrence(df, column, min_count=min_weight), margins(df, column)).select("a", "b", "n", "jaccard")


def expected_gaps(df: DataFrame, column: str, min_items: int = 5, gap: float = 0.8, below: int = 5, top_n: int = 200) -> DataFrame:
    """Pairs of the top_n items seen together less than expected: (a, b, n, expected, gap). Pairs never seen are made from these items, so there are
    top_n ** 2 / 2 at most."""
    m = margins(df, column).where(F.col("k") >= min_items).orderBy(F.desc("k"), "item").limit(top_n)
    n = df.select(F.count("*")).scalar()
    a = m.select(F.col("item").alias("a"), F.col("k").alias("ka"))
    b = m.select(F.col("item").alias("b"), F.col("k").alias("kb"))
    every = a.join(b, F.col("a") < F.col("b"))
    seen = cooccurrence(df, column)
    out = every.join(seen, ["a", "b"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "expected": F.col("ka") * F.col("kb") / n})
    return out.withColumn("gap", (F.col("expected") - F.col("n")) / F.col("expected")).where((F.col("expected") > 1) & (F.col("gap") > gap) & (F.col("n") < below)).select("a", "b", "n", "expected", "gap")


def combination_gaps(df: DataFrame, column: str, size: int = 3, min_expected: float = 5.0, gap: float = 2.0, top_n: int = 200, prior: DataFrame | None = None, usual: float = 0.3) -> DataFrame:
    """(items, n, expected, gap): sets of 2 to size items, in order, that fewer documents hold than expected: expected / max(n, 1) is gap or more. Expected is what independence
    gives, times 1 + the mean prior of the set's pairs (prior: a, b, prior with a < b, not negative; `usual` for others), and at least min_expected; among the top_n items.

    A set is expected no more often than its parts are, so sets grow level by level from pairs that can still be expected often enough; documents' sets are counted
    only where they are among these, and grow by joins within the document on the last item. Sets never seen are there, with n = 0. Null and empty lists hold no set."""
    m = margins(df, column).orderBy(F.desc("k"), "item").limit(top_n)
    n = df.select(F.count("*")).scalar()
    most = F.lit(usual) if prior is None else F.greatest(F.lit(usual), F.coalesce(prior.select(F.max("prior")).scalar(), F.lit(usual)))
    often = lambda t: t.where(F.col("expected") * (1 + most) >= min_expected - 1e-9)
    a, b = m.select(F.col("item").alias("a"), F.col("k").alias("ka")), m.select(F.col("item").alias("b"), F.col("k").alias("kb"))
    # top_n ** 2 / 2 pairs at most
    two = cut(often(a.join(b, F.col("a") < F.col("b")).withColumn("expected", F.col("ka") * F.col("kb") / n)).select("a", "b", "kb", "expected"))
    sets = two.select(F.array("a", "b").alias("items"), F.col("b").alias("last"), "expected")
    held = pairs(df, column).join(F.broadcast(two.select("a", "b")), ["a", "b"], "left_semi") if top_n <= 1000 else pairs(df, column).join(two.select("a", "b"), ["a", "b"], "left_semi")
    rows = held.select("doc_id", F.array("a", "b").alias("items"), F.col("b").alias("last"))
    every, seen = sets, rows.groupBy("items").agg(F.count("*").alias("n"))
    for _ in range(size - 2):
        grown = sets.join(two.select(F.col("a").alias("last"), F.col("b").alias("next"), "kb"), "last")
        sets = cut(often(grown.select(F.concat("items", F.array("next")).alias("items"), F.col("next").alias("last"), (F.col("expected") * F.col("kb") / n).alias("expected"))))
        more = held.select("doc_id", F.col("a").alias("last"), F.col("b").alias("next"))
        rows = rows.join(more, ["doc_id", "last"]).select("doc_id", F.concat("items", F.array("next")).alias("items"), F.col("next").alias("last")).join(sets.select("items"), "items", "left_semi")
        every, seen = every.union(sets), seen.union(rows.groupBy("items").agg(F.count("*").alias("n")))
    out = every.select("items", "expected").join(seen, "items", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if prior is None:
        out = out.withColumn("expected", F.col("expected") * (1 + usual))
    else:
        both = pairs(out.select("items"), "items", ["items"]).join(prior.select("a", "b", "prior"), ["a", "b"], "left")
        mean = both.groupBy("items").agg(F.avg(F.coalesce("prior", F.lit(usual))).alias("_p"))
        out = out.join(mean, "items").withColumn("expected", F.col("expected") * (1 + F.col("_p"))).drop("_p")
    out = out.withColumn("gap", F.col("expected") / F.greatest("n", F.lit(1)))
    return out.where((F.col("expected") >= min_expected - 1e-9) & (F.col("gap") >= gap - 1e-9)).select("items", "n", "expected", "gap")
