"""Scholarly web services as a data source of the engine: comparisons with constants reach the service, a task follows the pages of one part (such as a year),
and a task that is lost asks for its own pages again."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from folioscope.sources.api import WORK, Client, work_row

#: An author and an institution as rows.
AUTHOR = "id string, orcid string, name string, works int, cited_by int, h_index int, institutions array<string>, countries array<string>"
INSTITUTION = "id string, ror string, name string, country string, type string, works int, cited_by int"


def _short(r: dict, key: str) -> str | None:
    return (r.get(key) or "").rsplit("/", 1)[-1] or None


def author_row(r: dict) -> dict:
    """An author's record as a row of AUTHOR; what is missing is null or an empty list."""
    places = r.get("last_known_institutions") or []
    return {
        "id": _short(r, "id"), "orcid": _short(r, "orcid"), "name": r.get("display_name"), "works": r.get("works_count"), "cited_by": r.get("cited_by_count"), "h_index": (r.get("summary_stats") or {}).get("h_index"),
        "institutions": [i.get("display_name") for i in places], "countries": sorted({i["country_code"] for i in places if i.get("country_code")}),
    }


def institution_row(r: dict) -> dict:
    """An institution's record as a row of INSTITUTION."""
    return {"id": _short(r, "id"), "ror": _short(r, "ror"), "name": r.get("display_name"), "country": r.get("country_code"), "type": r.get("type"), "works": r.get("works_count"), "cited_by": r.get("cited_by_count")}


@dataclass(frozen=True)
class Endpoint:
    """What a service has: its path, rows and their schema; the column that parts go by; the service's own filter for each column that it can filter by."""

    path: str
    schema: str
    row: Callable[[dict], dict]
    split: str
    fields: dict[str, str]


WORKS = Endpoint("works", WORK, work_row, "year", {"year": "publication_year", "document_type": "type", "language": "language", "open_access": "is_oa"})
AUTHORS = Endpoint("authors", AUTHOR, author_row, "countries", {"countries": "last_known_institutions.country_code"})  # a list: only the caller's values choose parts
INSTITUTIONS = Endpoint("institutions", INSTITUTION, institution_row, "country", {"country": "country_code", "type": "type"})


@dataclass
class Part(InputPartition):
    filters: dict


@dataclass
class Reader(DataSourceReader):
    """Asks for the parts that the filters leave. All filters stay with the engine too, so a service that compares more loosely gives no wrong row."""

    client: Client
    endpoint: Endpoint
    names: list[str]
    values: list
    more: dict = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tests = {EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w}
        for f in filters:
            test, column = tests.get(type(f)), getattr(f, "attribute", ("",))[0]
            if test and column == self.endpoint.split:
                if self.values and isinstance(f.value, type(self.values[0])) or isinstance(f, In):
                    self.values = [v for v in self.values if test(v, f.value)]
            elif isinstance(f, (EqualTo, In)) and column in self.endpoint.fields and column not in self.more:
                self.more[column] = list(f.value) if isinstance(f, In) else f.value
        return filters

    def partitions(self) -> list[Part]:
        more = {self.endpoint.fields[c]: v for c, v in self.more.items()}
        # a source without parts has one empty one
        return [Part({self.endpoint.fields[self.endpoint.split]: v, **more}) for v in self.values] or [Part({})]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.filters:
            for r in self.client.records(self.endpoint.path, partition.filters):
                got = self.endpoint.row(r)
                yield tuple(got.get(n) for n in self.names)


def connect(spark: SparkSession, client: Client, endpoint: Endpoint, values: list) -> DataFrame:
    """All records of an endpoint whose split column has one of the values (a task each); records without it are in no part. Filters that a query puts on year, type, language,
    access or country choose parts and go into the requests. It sets the session's spark.sql.python.filterPushdown.enabled, which is read when a query is planned."""
    names = spark.createDataFrame([], endpoint.schema).columns

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"scholarly-{endpoint.path}"

        def schema(self) -> str:
            return endpoint.schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(client, endpoint, names, list(values))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return spark.read.format(Source.name()).load()


#: (file, place, reader) of the page that this process read last.
_LAST: list[tuple[str, int, io.BufferedReader]] = []


def _at(fs: FileSystem, path: str, place: int) -> io.BufferedReader:
    """A file's text from a place on: the reader that stands there, or a new one, as compressed text has no other way."""
    while _LAST:
        before, stands, f = _LAST.pop()
        if (before, stands) == (path, place):
            return f
        f.close()
    f = io.BufferedReader(fs.open_input_stream(path), 1 << 20)
    while place and (got := len(f.read(min(place, 1 << 20)))):
        place -= got
    return f


@dataclass(frozen=True)
class Pages:
    """A service's answers kept as files, to be read again without the service: a folder for each path and part (path/part=value, with values that stand in a folder's name as they are), a page in a line as {"results": [...]}.
    Other filters (a|b is either) are compared with the records' own fields. A cursor is a file's number and a place in its text. Files may be compressed, as their ending says; the one
    read last stays open, so the pages that follow each other are unpacked once."""

    folder: str
    parts: dict[str, str]

    def __call__(self, path: str, parameters: dict) -> dict:
        wanted = {k: v.split("|") for k, v in (p.split(":", 1) for p in parameters["filter"].split(",") if p)}
        part = self.parts[path]
        fs, root = FileSystem.from_uri(self.folder)
        files = []
        for value in wanted.pop(part):
            files += sorted(i.path for i in fs.get_file_info(FileSelector(f"{root}/{path}/part={value}", allow_not_found=True)) if i.is_file and not i.base_name.startswith(("_", ".")))
        at, place = (0, 0) if parameters["cursor"] == "*" else map(int, parameters["cursor"].split(":"))
        while at < len(files):
            f = _at(fs, files[at], place)
            line = f.readline()
            if line:
                _LAST.append((files[at], place + len(line), f))
            else:
                f.close()
            at, place = (at, place + len(line)) if line else (at + 1, 0)
            results = [r for r in json.loads(line)["results"] if all(str(r.get(k)).lower() in [v.lower() for v in vs] for k, vs in wanted.items())] if line else []
            if results:  # a page without what was asked for is passed over
                return {"meta": {"next_cursor": f"{at}:{place}"}, "results": results}
        return {"meta": {"next_cursor": None}, "results": []}


def keep_pages(records: DataFrame, part: str, folder: str, path: str, per_page: int = 200) -> None:
    """Writes records, a struct column `record` and the value of its part, as Pages reads them, compressed: about per_page in a page, however many a part has."""
    many = records.groupBy(part).count().selectExpr(part, f"int(ceil(count / {per_page})) AS _pages")
    dealt = records.join(many, part).selectExpr(part, "record", "pmod(xxhash64(record.id), _pages) AS _page")
    pages = dealt.groupBy(part, "_page").agg({"record": "collect_list"}).toDF("part", "_page", "results").selectExpr("part", "to_json(struct(results)) AS value")
    pages.write.partitionBy("part").option("compression", "gzip").text(f"{folder}/{path}")


def kept(folder: str, per_page: int = 200) -> Client:
    """A client over kept pages of works, authors and institutions."""
    return replace(Client(Pages(folder, {e.path: e.fields[e.split] for e in (WORKS, AUTHORS, INSTITUTIONS)})), per_page=per_page)
