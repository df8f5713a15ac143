"""The fluent front: a corpus, its filters and its analyses. Every method returns a DataFrame or a new Corpus; nothing is kept on the side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import schema
from folioscope.operators import cooccurrence, counting, diversity, groups, impact, laws, stats
from folioscope.operators import timeseries as ts
from folioscope.operators.longform import list_column, long
from folioscope.sources import files

_ANALYSES: dict[str, Callable] = {}


def register_analysis(name: str) -> Callable:
    """Registers a function of a Corpus under a name, for Corpus.run."""

    def put(f: Callable) -> Callable:
        _ANALYSES[name] = f
        return f

    return put


class Corpus:
    """Publications with columns doc_id, year, source, cited_by and lists authors, keywords, refs, countries, where they are there."""

    LISTS = ("authors", "author_keywords", "index_keywords", "keywords", "references", "refs", "countries", "affiliations")

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def read(cls, spark: SparkSession, path: str, db: str = "generic", **options) -> Corpus:
        """A file of a database, with lists as arrays, numbers as integers and ids by content."""
        df = files.read(spark, path, db, **options)
        change = {c: list_column(df, c, " and " if db == "bibtex" else "; ") for c in cls.LISTS if c in df.columns}
        for c in ("year", "cited_by"):
            if c in df.columns:
                change[c] = F.col(c).try_cast("double").cast("int")
        df = df.withColumns(change)
        if "cited_by" in df.columns:
            df = df.fillna({"cited_by": 0})
        if "doc_id" not in df.columns:
            df = df.withColumn("doc_id", F.xxhash64(*(F.col(f"`{c}`").cast("string") for c, t in df.dtypes if not t.startswith(("map", "struct")))))
        if "author_keywords" in df.columns and "keywords" not in df.columns:
            df = df.withColumnRenamed("author_keywords", "keywords")
        return cls(df)

    # filters ----------------------------------------------------------------------------------------------------

    def filter(self, years: tuple[int, int] | None = None, sources: list[str] | None = None, authors: list[str] | None = None, keywords: list[str] | None = None, countries: list[str] | None = None, min_citations: int | None = None, query: str | None = None, text: tuple[str, ...] = ("title", "abstract")) -> Corpus:
        """Documents that meet all conditions given; query: a plain substring of one of the text columns, in any case."""
        ok = F.lit(True)
        if years:
            ok = ok & F.col("year").between(*years)
        if sources:
            ok = ok & F.col("source").isin(sources)
        for column, wanted in (("authors", authors), ("keywords", keywords), ("countries", countries)):
            if wanted:
                ok = ok & F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, wanted))), F.lit(False))
        if min_citations is not None:
            ok = ok & (F.col("cited_by") >= min_citations)
        if query:
            ok = ok & F.lower(F.concat_ws("\n", *(c for c in text if c in self.df.columns))).contains(query.lower())
        return Corpus(self.df.where(ok))

    def where(self, rules: dict[str, dict]) -> Corpus:
        """Rules by column: regex_include, regex_exclude (lists: any), include, exclude (lists), min, max."""
        ok = F.lit(True)
        for column, rule in rules.items():
            c = F.col(f"`{column}`")
            text = F.coalesce(c.cast("string"), F.lit(""))
            if rule.get("regex_include"):
                ok = ok & text.rlike("(?i)" + "|".join(f"(?:{p})" for p in rule["regex_include"]))
            if rule.get("regex_exclude"):
                ok = ok & ~text.rlike("(?i)" + "|".join(f"(?:{p})" for p in rule["regex_exclude"]))
            if rule.get("include"):
                ok = ok & F.coalesce(text.isin([str(v) for v in rule["include"]]), F.lit(False))
            if rule.get("exclude"):
                ok = ok & ~text.isin([str(v) for v in rule["exclude"]])
            for key, sign in (("min", 1), ("max", -1)):
                if rule.get(key) is not None:
                    v = c.try_cast("double") if isinstance(rule[key], (int, float)) else c.try_cast("timestamp")
                    ok = ok & F.coalesce(v >= F.lit(rule[key]) if sign == 1 else v <= F.lit(rule[key]), F.lit(False))
        return Corpus(self.df.where(ok))

    def bradford(self, zones: list[int], column: str = "source") -> Corpus:
        """Documents of sources in the zones (thirds of the sources by rank)."""
        zoned = laws.bradford_by_sources(self.df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("item")).agg(F.count("*").alias("n_docs")))
        keep = zoned.where(F.col("zone").isin(zones)).select(F.col("item").alias(column))
        return Corpus(self.df.join(keep, column, "left_semi").select(*self.df.columns))

    def removed(self, kept: Corpus) -> DataFrame:
        """Documents of this corpus that kept lacks."""
        return self.df.join(kept.df.select("doc_id"), "doc_id", "left_anti")

    # analyses ---------------------------------------------------------------------------------------------------

    def count(self, column: str, **options) -> DataFrame:
        """Counts by the column's kind: list, or single."""
        mode = options.pop("mode", "list" if self.df.schema[column].dataType.simpleString().startswith("array") else "single")
        return counting.count_occurrences(self.df, column, mode, **options)

    def stats(self, column: str, **options) -> DataFrame:
        mode = "list" if self.df.schema[column].dataType.simpleString().startswith("array") else "single"
        return counting.entity_stats(self.df, column, mode, **options)

    def main_info(self) -> DataFrame:
        return counting.main_info(self.df)

    def production(self) -> DataFrame:
        return counting.production(self.df)

    def top_cited(self, n: int = 10, per_year: bool = False) -> DataFrame:
        return counting.top_cited(self.df, n, per_year)

    def trend(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return ts.trend(self.df, first, last)

    def cooccurrence(self, column: str = "keywords", **options) -> DataFrame:
        return cooccurrence.cooccurrence(self.df, column, **options)

    def coupling(self, column: str = "refs", at_least: int = 1) -> DataFrame:
        return cooccurrence.coupling(self.df, column, at_least)

    def normalised_citations(self, field: str | None = None, method: str = "mean") -> DataFrame:
        return impact.field_normalized(self.df, field, method)

    def diversity(self, column: str, by: list[str] | None = None) -> DataFrame:
        return diversity.entity_diversity(self.df, column, by)

    def collaboration(self) -> DataFrame:
        return stats.collaboration(self.df)

    def compare_means(self, value: str, by: str) -> dict:
        return stats.compare_means(self.df, value, by)

    def groups(self, column: str) -> Groups:
        return Groups(self.df, groups.membership(self.df, column))

    def items(self, column: str) -> DataFrame:
        """(doc_id, item) of a list."""
        return long(self.df, column)

    def database(self) -> str:
        return schema.detect_database(self.df)

    def labels(self) -> DataFrame:
        """doc_id with 'First author (year)' and the same with title."""
        first = F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("Anonymous"))
        short = F.concat(first, F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(")"))
        title = F.col("title") if "title" in self.df.columns else F.lit(None).cast("string")
        return self.df.select("doc_id", short.alias("short"), F.concat_ws(" ", short, title).alias("label"))

    def newest_of(self, column: str) -> DataFrame:
        """The latest document of each value."""
        place = F.row_number().over(Window.partitionBy(column).orderBy(F.desc("year"), "doc_id"))
        return self.df.withColumn("_i", place).where("_i = 1").drop("_i")

    def run_all(self, skip_errors: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """The usual tables by name, lazily, and what could not be planned because a column is missing."""
        lists = [c for c in ("authors", "keywords", "refs", "countries") if c in self.df.columns]
        plans = {"main_info": self.main_info, "production": self.production, "trend": self.trend, "top_cited": self.top_cited, "normalised_citations": self.normalised_citations, "collaboration": self.collaboration, "labels": self.labels}
        plans |= {f"count_{c}": (lambda c=c: self.count(c)) for c in [*lists, "source"]} | {f"stats_{c}": (lambda c=c: self.stats(c)) for c in lists} | {f"cooccurrence_{c}": (lambda c=c: self.cooccurrence(c)) for c in lists} | {f"diversity_{c}": (lambda c=c: self.diversity(c)) for c in lists}
        tables, errors = {}, {}
        for name, plan in plans.items():
            try:
                tables[name] = plan()
            except Exception as e:
                if not skip_errors:
                    raise
                errors[name] = str(e).split("\n")[0]
        return tables, errors

    def run(self, name: str, **options):
        """A registered analysis."""
        if name not in _ANALYSES:
            raise KeyError(f"no analysis {name!r}; there are: {', '.join(sorted(_ANALYSES)) or 'none'}")
        return _ANALYSES[name](self, **options)


class Groups:
    """A corpus with membership of its documents in groups."""

    def __init__(self, df: DataFrame, members: DataFrame):
        self.df, self.members = df, members

    def count(self, column: str, merge: str = "all") -> DataFrame:
        return groups.count_items(self.df, self.members, column, merge)

    def intersections(self, ids: bool = False) -> DataFrame:
        return groups.intersections(self.members, ids)

    def similarity(self) -> DataFrame:
        return groups.similarity(self.members)

    def production(self) -> DataFrame:
        return groups.production(self.df, self.members)

    def top_cited(self, n: int = 10) -> DataFrame:
        return groups.top_cited(self.df, self.members, n)

    def compare(self, value: str) -> DataFrame:
        return groups.compare_continuous(self.df, self.members, value)

    def profile(self) -> DataFrame:
        return groups.profile(self.df, self.members)

    def associations(self, column: str, top_n: int = 50) -> DataFrame:
        return groups.associations(self.df, self.members, column, top_n)
