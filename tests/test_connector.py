import json
from collections import Counter

import pytest

from folioscope.sources import connector
from folioscope.sources.api import Client


@pytest.fixture
def pages(tmp_path):
    """Works of four years in pages of three, two files a year; a page without articles in between."""
    for y in range(2000, 2004):
        folder = tmp_path / "works" / f"part={y}"
        folder.mkdir(parents=True)
        made = [{"id": f"w/W{y}-{i}", "display_name": f"Work {i}", "publication_year": y, "type": "book" if 3 <= i < 6 else "article", "language": "en" if i % 2 else None} for i in range(10)]
        lines = [json.dumps({"results": made[i : i + 3]}) for i in range(0, 10, 3)]
        (folder / "a.txt").write_text("\n".join(lines[:2]) + "\n")
        (folder / "b.txt").write_text("\n".join(lines[2:]) + "\n")
        (folder / "_SUCCESS").write_text("")
    return f"file://{tmp_path}"


def test_all_and_filtered(spark, pages):
    works = connector.connect(spark, connector.kept(pages), connector.WORKS, list(range(2000, 2005)))
    assert works.count() == 40 and works.select("id").distinct().count() == 40
    got = works.where("year > 2000 AND year <= 2002 AND document_type = 'article' AND title LIKE 'Work%'")
    assert Counter(r["year"] for r in got.collect()) == {2001: 7, 2002: 7}
    assert works.where("language IS NULL").count() == 20
    assert works.where("year = 1990").collect() == []
    assert connector.connect(spark, connector.kept(pages), connector.WORKS, []).collect() == []


def test_pushed(spark, pages, tmp_path):
    """Filters choose parts and stand in the requests; a call that fails is made again by its task alone."""
    log, inner = str(tmp_path / "calls"), connector.kept(pages).transport

    def transport(path, parameters):
        with open(log, "a") as f:
            f.write(parameters["filter"] + "\n")
        seen = open(log).read().count(parameters["filter"] + "\n")
        if seen == 1:
            raise OSError("not now")
        return inner(path, parameters)

    works = connector.connect(spark, Client(transport, pause=0.0), connector.WORKS, list(range(2000, 2004)))
    assert works.where("year IN (2001, 2003) AND document_type IN ('book', 'article')").count() == 20
    assert {x.split(",")[0] for x in open(log).read().split()} == {"publication_year:2001", "publication_year:2003"}
    assert all(x.endswith((",type:book|article", ",type:article|book")) for x in open(log).read().split())


def test_keep_pages(spark, tmp_path):
    """One part with most of the records gets more pages, not larger ones."""
    rows = spark.range(3000).selectExpr("if(id % 10 = 0, 2001, 2000) AS year", "named_struct('id', concat('w/W', id), 'publication_year', if(id % 10 = 0, 2001, 2000)) AS record")
    folder = f"file://{tmp_path}/kept"
    connector.keep_pages(rows, "year", folder, "works", 100)
    sizes = [len(json.loads(r["value"])["results"]) for r in spark.read.text(f"{folder}/works").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 200
    assert connector.connect(spark, connector.kept(folder), connector.WORKS, [2000, 2001]).select("id").distinct().count() == 3000


def test_pages_are_compressed(spark, tmp_path):
    """Kept pages take a fraction of their text; a cursor works from its place on, whoever read before."""
    rows = spark.range(2000).selectExpr("2000 AS year", "named_struct('id', concat('w/W', id), 'display_name', repeat('on plans ', 20), 'publication_year', 2000) AS record")
    folder = f"file://{tmp_path}/kept"
    connector.keep_pages(rows, "year", folder, "works", 100)
    text = sum(len(r["value"]) for r in spark.read.text(f"{folder}/works").collect())
    assert sum(f.stat().st_size for f in (tmp_path / "kept").rglob("part-*")) < text / 5
    ask, asked = connector.kept(folder).transport, {"filter": "publication_year:2000", "cursor": "*"}
    seen, cursors = [], []
    while asked["cursor"]:
        cursors.append(asked["cursor"])
        got = ask("works", asked)
        seen.append([r["id"] for r in got["results"]])
        asked = asked | {"cursor": got["meta"]["next_cursor"]}
    assert len({i for x in seen for i in x}) == sum(map(len, seen)) == 2000
    for k in (3, 1, 7):
        assert [r["id"] for r in ask("works", asked | {"cursor": cursors[k]})["results"]] == seen[k]


def test_rows_of_empty_records():
    assert connector.author_row({}) == {"id": None, "orcid": None, "name": None, "works": None, "cited_by": None, "h_index": None, "institutions": [], "countries": []}
    assert set(connector.institution_row({}).values()) == {None}
