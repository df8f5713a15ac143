"""Paged web sources. Requests are made by a function that the caller gives, so that nothing here needs a network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filter_string(filters: dict) -> str:
    """Predicates in the usual query grammar of scholarly APIs: lists as a|b, booleans in small letters, comma between."""

    def text(v) -> str:
        return "|".join(map(text, v)) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v)

    return ",".join(f"{k}:{text(v)}" for k, v in filters.items())


def paged(spark: SparkSession, fetch: Callable[[int], list[dict]], pages: int, schema: str, tasks: int = 4) -> DataFrame:
    """Rows of fetch(0) to fetch(pages - 1), spread over tasks; fetch must give the same rows if a task runs again."""
    names = spark.createDataFrame([], schema).columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for page in pdf["id"]:
                yield pd.DataFrame([[r.get(n) for n in names] for r in fetch(int(page))], columns=names)

    return spark.range(0, pages, 1, tasks).mapInPandas(run, schema)


def keyed(df: DataFrame, key: str, fetch: Callable[[list], list[dict]], schema: str) -> DataFrame:
    """Rows that fetch gives for the distinct keys of df, a batch of keys at a time: to be joined back."""
    names = df.sparkSession.createDataFrame([], schema).columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), 50):
                yield pd.DataFrame([[r.get(n) for n in names] for r in fetch(pdf[key].iloc[i : i + 50].tolist())], columns=names)

    return df.select(key).where(df[key].isNotNull()).distinct().mapInPandas(run, schema)


@dataclass(frozen=True)
class Client:
    """A scholarly web service with pages behind a cursor. transport(path, parameters) returns the parsed answer: {"meta": {"next_cursor": ...}, "results": [...]};
    it is sent to the tasks, so it must be picklable. A failed call is made again after pause, twice pause, ... seconds, retries times."""

    transport: Callable[[str, dict], dict]
    per_page: int = 200
    retries: int = 3
    pause: float = 0.1

    def get(self, path: str, parameters: dict) -> dict:
        for left in range(self.retries, -1, -1):
            try:
                return self.transport(path, parameters)
            except OSError:
                if not left:
                    raise
                time.sleep(self.pause * 2 ** (self.retries - left))
        raise AssertionError

    def records(self, path: str, filters: dict, limit: int | None = None, **more) -> Iterator[dict]:
        """Records page by page until the cursor ends, or limit of them."""
        cursor, n = "*", 0
        while cursor:
            page = self.get(path, {"filter": filter_string(filters), "per-page": self.per_page, "cursor": cursor, **more})
            for r in page.get("results") or []:
                if limit is not None and n >= limit:
                    return
                n += 1
                yield r
            cursor = (page.get("meta") or {}).get("next_cursor") if page.get("results") else None


#: A work as a row.
WORK = "id string, doi string, title string, year int, cited_by int, document_type string, language string, open_access boolean, source string, authors array<string>, author_ids array<string>, institutions array<string>, countries array<string>, keywords array<string>, references array<string>, abstract string"


def work_row(r: dict) -> dict:
    """A work's record as a row of WORK; what is missing is null or an empty list."""
    people = r.get("authorships") or []
    places = [i for p in people for i in p.get("institutions") or []]
    source = ((r.get("primary_location") or {}).get("source") or {}).get("display_name")
    words = sorted((i, w) for w, at in (r.get("abstract_inverted_index") or {}).items() for i in at)
    once = lambda items: list(dict.fromkeys(x for x in items if x))
    return {
        "id": (r.get("id") or "").rsplit("/", 1)[-1] or None, "doi": (r.get("doi") or "").lower().removeprefix("https://doi.org/") or None, "title": r.get("display_name") or r.get("title"), "year": r.get("publication_year"),
        "cited_by": r.get("cited_by_count"), "document_type": r.get("type"), "language": r.get("language"), "open_access": (r.get("open_access") or {}).get("is_oa"), "source": source,
        "authors": [(p.get("author") or {}).get("display_name") for p in people], "author_ids": [((p.get("author") or {}).get("id") or "").rsplit("/", 1)[-1] or None for p in people],
        "institutions": once(i.get("display_name") for i in places), "countries": once(i.get("country_code") for i in places), "keywords": once(k.get("display_name") for k in r.get("keywords") or []),
        "references": [x.rsplit("/", 1)[-1] for x in r.get("referenced_works") or []], "abstract": " ".join(w for _, w in words) or None,
    }


def search(spark: SparkSession, client: Client, path: str, parts: list[dict], schema: str = WORK, row: Callable[[dict], dict] = work_row, limit: int | None = None) -> DataFrame:
    """Records of all parts, each a set of filters whose pages one task follows (such as one for each year): a cursor is sequential, parts aren't. limit: of each part."""
    names = spark.createDataFrame([], schema).columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in pdf["id"]:
                held: list[list] = []
                for r in client.records(path, parts[int(k)], limit):
                    got = row(r)
                    held.append([got.get(n) for n in names])
                    if len(held) >= 1000:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInPandas(run, schema)


def entity(client: Client, path: str, key: str, row: Callable[[dict], dict] = work_row) -> dict:
    """One record by its id."""
    return row(client.get(f"{path}/{key}", {}))


def grouped(spark: SparkSession, client: Client, path: str, filters: dict, by: str) -> DataFrame:
    """(key, label, n): the service's own counts by a field, such as works by year, country or open access status."""
    answer = client.get(path, {"filter": filter_string(filters), "group_by": by})
    return spark.createDataFrame([(str(g.get("key")), g.get("key_display_name"), int(g["count"])) for g in answer.get("group_by") or []], "key string, label string, n long")


def enriched(df: DataFrame, client: Client, key: str, path: str = "works", field: str = "doi", schema: str = WORK, row: Callable[[dict], dict] = work_row) -> DataFrame:
    """df joined to the records of its distinct keys, asked for fifty at a time; rows without a record stay."""
    got = keyed(df, key, lambda keys: [row(r) for r in client.records(path, {field: [str(k) for k in keys]})], schema)
    return df.join(got.select(F.col(field).alias("_key"), F.struct(*got.columns).alias("found")), df[key] == F.col("_key"), "left").drop("_key")
