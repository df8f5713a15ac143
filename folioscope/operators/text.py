"""Text mining: boolean queries, term profiles and drift, TF-IDF, readability, pattern classifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.counting import ngrams, tokens


def parse_query(query: str) -> tuple:
    """A boolean query as a tree: ('or', ...), ('and', ...) or ('term', pattern). OR binds looser than AND; {exact phrase}, * as a wildcard, parentheses."""
    parts = re.findall(r"\{[^}]*\}|\(|\)|\"[^\"]*\"|[^\s()]+", query)

    def either(i: int) -> tuple[tuple, int]:
        left, i = both(i)
        terms = [left]
        while i < len(parts) and parts[i].upper() == "OR":
            right, i = both(i + 1)
            terms.append(right)
        return (terms[0] if len(terms) == 1 else ("or", *terms)), i

    def both(i: int) -> tuple[tuple, int]:
        left, i = one(i)
        terms = [left]
        while i < len(parts) and parts[i].upper() not in ("OR", ")"):
            right, i = one(i + (parts[i].upper() == "AND"))
            terms.append(right)
        return (terms[0] if len(terms) == 1 else ("and", *terms)), i

    def one(i: int) -> tuple[tuple, int]:
        if i >= len(parts):
            raise ValueError(f"query ends early: {query}")
        if parts[i] == "(":
            tree, i = either(i + 1)
            if i >= len(parts) or parts[i] != ")":
                raise ValueError(f"missing ')': {query}")
            return tree, i + 1
        text = parts[i].strip('{}"')
        words = r"\s+".join(re.escape(w).replace(r"\*", r"\w*") for w in text.split())
        return ("term", rf"\b{words}\b"), i + 1

    tree, i = either(0)
    if i != len(parts):
        raise ValueError(f"cannot read from {parts[i]!r}: {query}")
    return tree


def query_column(query: str | tuple, text: Column) -> Column:
    """The query as one column expression; null texts match nothing."""
    tree = parse_query(query) if isinstance(query, str) else query
    if tree[0] == "term":
        return F.coalesce(text.rlike(f"(?iU){tree[1]}"), F.lit(False))
    parts = [query_column(t, text) for t in tree[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out | p if tree[0] == "or" else out & p
    return out


def goals(df: DataFrame, text: str, queries: dict[str, str], perspectives: dict[str, list[str]] | None = None) -> DataFrame:
    """df with a 0/1 column for each query, one for each perspective (the greatest of its members) and any_goal."""
    flags = {k: query_column(q, F.col(text)).cast("int") for k, q in queries.items()}
    out = df.withColumns(flags)
    more = {f"perspective_{k}": (F.greatest(*v) if len(v) > 1 else F.col(v[0])) for k, v in (perspectives or {}).items()}
    any_ = F.greatest(*flags) if len(flags) > 1 else F.col(next(iter(flags)))
    return out.withColumns(more | {"any_goal": any_})


def bridge_score(flags: list[str], perspectives: dict[str, list[str]]) -> Column:
    """0.3 * min(n / 5, 1) + 0.4 * share of perspectives touched + 0.3 * mean distance of the goals' places, of the goals set."""
    n = sum((F.col(f) for f in flags), F.lit(0))
    touched = sum((F.greatest(*v) if len(v) > 1 else F.col(v[0]) for v in perspectives.values()), F.lit(0))
    places = F.filter(F.array(*(F.when(F.col(f) == 1, F.lit(i)) for i, f in enumerate(flags))), lambda x: x.isNotNull())
    spread = F.when(n > 1, (F.array_max(places) - F.array_min(places)) / (len(flags) - 1)).otherwise(0.0)
    return 0.3 * F.least(n / 5, F.lit(1.0)) + 0.4 * touched / len(perspectives) + 0.3 * spread


def term_counts(df: DataFrame, text: str, by: list[str] | None = None, n_min: int = 1, n_max: int = 1) -> DataFrame:
    """(by..., term, tf, df): occurrences and documents of each term."""
    by = by or []
    t = df.select("doc_id", *by, F.explode(ngrams(tokens(text), n_min, n_max)).alias("term")).groupBy("doc_id", *by, "term").agg(F.count("*").alias("k"))
    return t.groupBy(*by, "term").agg(F.sum("k").alias("tf"), F.count("*").alias("df"))


def tfidf(df: DataFrame, text: str, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(doc_id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1."""
    t = df.select("doc_id", F.explode(tokens(text)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("k"))
    by = t.groupBy("term").agg(F.count("*").alias("df"), F.sum("k").alias("tf")).where(F.col("df") >= min_df)
    if max_features:
        by = by.orderBy(F.desc("tf"), "term").limit(max_features)
    n = df.select(F.count("*")).scalar()
    t = t.join(by.select("term", "df"), "term").withColumn("w", F.col("k") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    return t.select("doc_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))).alias("weight"))


def tfidf_terms(weights: DataFrame) -> DataFrame:
    """(term, total, df, mean) over the documents that have the term."""
    return weights.groupBy("term").agg(F.sum("weight").alias("total"), F.count("*").alias("df"), F.avg("weight").alias("mean"))


def cosine_to(weights: DataFrame, query: dict[str, float]) -> DataFrame:
    """(doc_id, cosine) of documents that share a term with the query."""
    length = sum(v * v for v in query.values()) ** 0.5
    q = F.create_map(*[F.lit(x) for kv in query.items() for x in kv])
    return weights.where(F.col("term").isin(list(query))).groupBy("doc_id").agg((F.sum(F.col("weight") * F.try_element_at(q, F.col("term"))) / length).alias("cosine"))


def context_profile(df: DataFrame, text: str, target: str, window: int = 10, by: list[str] | None = None, min_count: int = 1) -> DataFrame:
    """(by..., term, n, share): words within window places of words that contain the target, taken inside each text."""
    by = by or []
    t = df.select(*by, tokens(text).alias("w")).where(F.exists("w", lambda x: x.contains(target)))
    w = F.col("w")
    places = F.filter(F.transform(w, lambda x, i: F.when(x.contains(target), i)), lambda i: i.isNotNull())
    near = F.flatten(F.transform(places, lambda i: F.filter(F.transform(w, lambda x, j: F.when((F.abs(j - i) <= window) & ~x.contains(target), x)), lambda x: x.isNotNull())))
    counts = t.select(*by, F.explode(near).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    total = F.sum("n").over(Window.partitionBy(*by)) if by else counts.select(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: Jensen-Shannon distance (base 2), cosine and Jaccard distance of two profiles (term, share)."""
    t = old.select("term", F.col("share").alias("p")).join(new.select("term", F.col("share").alias("q")), "term", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    js = F.sqrt(F.greatest(F.lit(0.0), F.sum(part(p) + part(q)) / 2))
    cos = 1 - F.sum(p * q) / F.sqrt(F.sum(p * p) * F.sum(q * q))
    jac = 1 - F.sum(((p > 0) & (q > 0)).cast("double")) / F.count("*")
    return t.agg(js.alias("jensen_shannon"), cos.alias("cosine"), jac.alias("jaccard"))


def emerging(old: DataFrame, new: DataFrame, rise: float = 2.0, fall: float = 0.5) -> DataFrame:
    """(term, old_share, new_share, ratio, status) of terms that emerge, fade or appear or vanish."""
    t = old.select("term", F.col("share").alias("o")).join(new.select("term", F.col("share").alias("n")), "term", "full").select("term", F.coalesce("o", F.lit(0.0)).alias("old_share"), F.coalesce("n", F.lit(0.0)).alias("new_share"))
    o, n = F.col("old_share"), F.col("new_share")
    return t.withColumn("ratio", F.when(o > 0, n / o)).withColumn("status", F.when(o == 0, "new").when(n == 0, "gone").when(n / o >= rise, "emerging").when(n / o <= fall, "fading")).where("status IS NOT NULL")


def readability(text: Column) -> Column:
    """(sentences, words, syllables, complex_share, flesch, grade): syllables are vowel groups, one at least; complex words have three or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))
    n = F.size(words)
    each = F.transform(words, lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))))
    syllables = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != "")))
    hard = F.size(F.filter(each, lambda x: x >= 3))
    ok = n > 0
    return F.struct(
        sentences.alias("sentences"), n.alias("words"), syllables.alias("syllables"), F.when(ok, hard / n).alias("complex_share"),
        F.when(ok, 206.835 - 1.015 * n / sentences - 84.6 * syllables / n).alias("flesch"), F.when(ok, 0.39 * n / sentences + 11.8 * syllables / n - 15.59).alias("grade"),
    )


def keyword_hits(text: Column, words: list[str]) -> Column:
    """The words that a text contains, in any case, in the order given."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def paradigm(text: Column, table: dict[str, list[str]]) -> Column:
    """quantitative, qualitative or mixed (the table's keys, with the words that speak for each): the kind with the most hits; mixed wins if it has any."""
    n = {k: F.size(keyword_hits(text, v)) for k, v in table.items()}
    return F.when(n["mixed"] > 0, "mixed").when(n["quantitative"] > n["qualitative"], "quantitative").when(n["qualitative"] > n["quantitative"], "qualitative").when(n["quantitative"] > 0, "mixed").otherwise("unclear")


def methodology(df: DataFrame, text: str, paradigms: dict[str, list[str]], designs: list[str], software: list[str]) -> DataFrame:
    """doc_id, paradigm, designs, software and sample sizes. The words to look for are the caller's: the library has no vocabulary of its own."""
    from folioscope.functions.strings import sample_sizes

    c = F.col(text)
    return df.select("doc_id", paradigm(c, paradigms).alias("paradigm"), keyword_hits(c, designs).alias("designs"), keyword_hits(c, software).alias("software"), sample_sizes(c).alias("sample_sizes"))


def methodology_summary(found: DataFrame) -> DataFrame:
    """(kind, item, documents, share) over a corpus: its paradigms, designs and software."""
    n = found.select(F.count("*")).scalar()
    kinds = [found.select(F.lit("paradigm").alias("kind"), F.col("paradigm").alias("item")), *(found.select(F.lit(c).alias("kind"), F.explode(c).alias("item")) for c in ("designs", "software"))]
    every = kinds[0].union(kinds[1]).union(kinds[2])
    return every.groupBy("kind", "item").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / n)


def practices(df: DataFrame, text: str, patterns: dict[str, str], uncounted: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, a flag for each practice of open science (name -> pattern, in any case) and the share of practices met, those uncounted (such as data on request) left out."""
    flags = {k: F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)).cast("int") for k, p in patterns.items()}
    met = [v for k, v in flags.items() if k not in uncounted]
    return df.select("doc_id", *(v.alias(k) for k, v in flags.items()), (sum(met, F.lit(0)) / len(met)).alias("score"))


def sentiment(df: DataFrame, text: str, positive: list[str], negative: list[str], hedges: list[str]) -> DataFrame:
    """doc_id, polarity = (p - n) / (p + n), hedging = hedges / words, tone at 0.1 either way. The lexicon is the caller's."""
    w = tokens(text)
    n = lambda words: F.size(F.filter(w, lambda x: x.isin(words)))
    t = df.select("doc_id", F.size(w).alias("words"), n(positive).alias("p"), n(negative).alias("n"), n(hedges).alias("h"))
    polarity = F.when(F.col("p") + F.col("n") > 0, (F.col("p") - F.col("n")) / (F.col("p") + F.col("n"))).otherwise(0.0)
    return t.select("doc_id", polarity.alias("polarity"), F.when(F.col("words") > 0, F.col("h") / F.col("words")).otherwise(0.0).alias("hedging"), F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral").alias("tone"))


def tone_summary(scores: DataFrame, by: DataFrame | None = None, key: str = "group_name") -> DataFrame:
    """(key if by is given, documents, polarity, hedging, positive, negative, neutral): means and shares of tones; by: (doc_id, key)."""
    t = scores if by is None else scores.join(by, "doc_id")
    share = lambda x: F.avg((F.col("tone") == x).cast("double")).alias(x)
    aggs = [F.count("*").alias("documents"), F.avg("polarity").alias("polarity"), F.avg("hedging").alias("hedging"), *map(share, ("positive", "negative", "neutral"))]
    return t.agg(*aggs) if by is None else t.groupBy(key).agg(*aggs)


#: Patterns of sentences and entities; callers may pass their own.
CLAIMS = r"\b(?:we|our results?|this (?:paper|study)) (?:show|demonstrate|find|found|propose|prove|suggest|confirm)\w*\b"
QUESTIONS = r"\b(?:research question|we (?:ask|investigate|examine)|aims? (?:of|to)|objective|hypothes[ie]s)\b"
ENTITIES = {"year": r"\b(?:19|20)\d{2}\b", "percent": r"\b\d+(?:\.\d+)?\s?%", "p_value": r"\bp\s*[<=>]\s*0?\.\d+", "acronym": r"\b[A-Z]{2,6}\b", "email": r"[\w.+-]+@[\w-]+\.[\w.]+"}


def sentences(text: Column) -> Column:
    """The sentences of a text: split after a full stop, question or exclamation mark and white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def matching_sentences(df: DataFrame, text: str, pattern: str = CLAIMS) -> DataFrame:
    """(doc_id, place, sentence) of sentences that match, in any case."""
    return df.select("doc_id", F.posexplode(sentences(F.col(text))).alias("place", "sentence")).where(F.col("sentence").rlike(f"(?i){pattern}"))


def entities(df: DataFrame, text: str, patterns: dict[str, str] = ENTITIES) -> DataFrame:
    """(doc_id, kind, value, n) of what the patterns find."""
    found = F.flatten(F.array(*(_tagged(text, k, p) for k, p in patterns.items())))
    return df.where(F.col(text).isNotNull()).select("doc_id", F.explode(found).alias("x")).groupBy("doc_id", "x.kind", "x.value").agg(F.count("*").alias("n"))


def _tagged(text: str, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def embedding_drift(df: DataFrame, text: str, terms: list[str], size: int = 5, dimensions: int = 50, least: int = 5, around: int = 10, min_docs: int = 100, seed: int = 1) -> DataFrame:
    """(term, start, next, shared, drift) of words between one window of years and the next: word vectors are learned for each window by itself, so it is a word's nearest
    neighbours that are compared; drift is 1 less the Jaccard index of the two sets. Windows of less than min_docs documents are left out."""
    from pyspark.ml.feature import Word2Vec

    from folioscope.operators.timeseries import windows

    t = windows(df.where(F.col(text).isNotNull()), size).select("start", tokens(text).alias("words"))
    starts = sorted(r["start"] for r in t.groupBy("start").count().where(F.col("count") >= min_docs).collect())  # a row for each window
    near: dict[int, dict[str, set[str]]] = {}
    for start in starts:
        model = Word2Vec(vectorSize=dimensions, minCount=least, seed=seed, inputCol="words", outputCol="v", numPartitions=1).fit(t.where(F.col("start") == start))
        known = {r[0] for r in model.getVectors().where(F.col("word").isin(terms)).select("word").collect()}
        near[start] = {w: {x for x, _ in model.findSynonymsArray(w, around)} for w in terms if w in known}
    rows = []
    for a, b in zip(starts, starts[1:], strict=False):
        for w in terms:
            if w in near[a] and w in near[b]:
                both, any_ = near[a][w] & near[b][w], near[a][w] | near[b][w]
                rows.append((w, a, b, len(both), 1 - len(both) / len(any_)))
    return df.sparkSession.createDataFrame(rows, "term string, start int, next int, shared int, drift double")
