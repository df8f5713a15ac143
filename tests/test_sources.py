import json

import pytest
from pyspark.sql import functions as F

from folioscope import schema
from folioscope.corpus import Corpus, register_analysis
from folioscope.sources import api, files, sinks

RIS = """TY  - JOUR
TI  - A first paper on
things that go on
AU  - Doe, Jane
AU  - Roe, Rick
PY  - 2001/05/01
JO  - Journal A
KW  - alpha
KW  - beta
DO  - 10.1000/x1
ER  - 

TY  - CONF
T1  - A second paper
A1  - Poe, Pat
Y1  - 1999
T2  - Proceedings B
ER  - 
"""
NBIB = """PMID- 123
TI  - Title one that is
      continued here.
FAU - Doe, Jane
FAU - Roe, Rick
DP  - 2003 Mar
JT  - Journal of X
AID - 10.1000/abc [doi]
MH  - Mice
MH  - Humans

PMID- 124
TI  - Title two.
DP  - 2004
"""
WOS = """FN Clarivate
VR 1.0
PT J
AU Doe, J
   Roe, R
TI A title over
   two lines
SO JOURNAL X
DE alpha; beta;
   gamma
PY 2005
TC 7
CR Smith A, 1990, J Y
   Jones B, 1991, J Z
ER

PT J
AU Poe, P
TI Other
PY 2006
TC 0
ER

EF
"""
BIB = """@comment{x}
@article{k1, title = {A {Nested {Deep}} Title}, author = "Doe, Jane and Roe, Rick", year = 2001, journal={J},
  keywords={a, b}}
@inproceedings{k2,
  title={Second = one}, booktitle = {Proc}, year={1999}
}
@misc{k3, note={no title}}
"""


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text, encoding="utf-8")
        return str(p)

    return write


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_ris(spark, put):
    got = sorted(rows(files.read(spark, put("a.ris", RIS), "scopus")), key=lambda r: r["year"])
    assert [r["title"] for r in got] == ["A second paper", "A first paper on things that go on"]
    assert got[1]["authors"] == "Doe, Jane; Roe, Rick" and got[1]["author_keywords"] == "alpha; beta" and got[1]["year"] == "2001" and got[1]["doi"] == "10.1000/x1"
    assert got[0]["authors"] == "Poe, Pat" and got[0]["source"] == "Proceedings B" and got[0]["doi"] is None


def test_medline(spark, put):
    got = sorted(rows(files.read(spark, put("a.nbib", NBIB), "PubMed")), key=lambda r: r["pmid"])
    assert got[0]["title"] == "Title one that is continued here." and got[0]["authors"] == "Doe, Jane; Roe, Rick" and got[0]["doi"] == "10.1000/abc" and got[0]["index_keywords"] == "Mice; Humans"
    assert got[1]["year"] == "2004" and got[1]["doi"] is None


def test_wos(spark, put):
    got = sorted(rows(files.read(spark, put("a.txt", WOS), "wos")), key=lambda r: r["year"])
    assert got[0]["title"] == "A title over two lines" and got[0]["authors"] == "Doe, J; Roe, R" and got[0]["references"] == "Smith A, 1990, J Y; Jones B, 1991, J Z"
    assert got[0]["author_keywords"] == "alpha; beta; gamma" and got[1]["title"] == "Other" and len(got) == 2


def test_bibtex(spark, put):
    got = {r["_citation_key"]: r for r in rows(files.read(spark, put("a.bib", BIB), "dblp"))}
    assert set(got) == {"k1", "k2"}
    assert got["k1"]["title"] == "A Nested Deep Title" and got["k1"]["authors"] == "Doe, Jane; Roe, Rick" and got["k1"]["year"] == "2001" and got["k1"]["author_keywords"] == "a; b"
    assert got["k2"]["title"] == "Second = one" and got["k2"]["source"] == "Proc"


def test_csv(spark, put):
    path = put("a.csv", 'Title,Year,Cited by,Authors,Empty\n"One, and\nmore",2001,5,"Doe, J; Roe, R",\nTwo,NA,x,n/a,-\n')
    df = files.csv(spark, path)
    assert files.drop_empty(df).columns == ["Title", "Year", "Cited by", "Authors"]
    assert dict(files.numeric(df).dtypes)["Year"] == "double" and dict(files.numeric(df).dtypes)["Cited by"] == "string"
    c = Corpus.read(spark, path, "scopus")
    got = {r["title"]: r for r in rows(c.df)}
    assert got["One, and\nmore"]["authors"] == ["Doe, J", "Roe, R"] and got["Two"]["cited_by"] == 0 and got["Two"]["year"] is None


def test_json_and_xml(spark, put):
    lens = put("a.json", json.dumps({"title": "T", "authors": [{"display_name": "A"}, {"display_name": "B"}], "fields": ["x", "y"], "open": {"is": True}}) + "\n")
    r = rows(files.json_records(spark, lens))[0]
    assert r["authors"] == "A; B" and r["fields"] == "x; y" and json.loads(r["open"]) == {"is": True}
    cr = put("c.json", json.dumps({"message": {"items": [{"DOI": "10.1/a", "title": ["T"], "author": [{"given": "J", "family": "Doe"}], "issued": {"date-parts": [[2001, 2]]}, "container-title": ["C"], "is-referenced-by-count": 3, "type": "x"}]}}))
    assert rows(files.read(spark, cr, "crossref"))[0] == {"doi": "10.1/a", "title": "T", "authors": "Doe, J", "year": 2001, "source": "C", "cited_by": 3, "document_type": "x"}
    oc = put("o.json", json.dumps({"group": [{"work-summary": [{"title": {"title": {"value": "W"}}, "publication-date": {"year": {"value": "2010"}}, "journal-title": {"value": "J"}, "type": "article", "external-ids": {"external-id": [{"external-id-type": "doi", "external-id-value": "10.1/b"}]}}]}]}))
    assert rows(files.read(spark, oc, "orcid"))[0]["doi"] == "10.1/b"
    dblp = put("d.xml", "<dblp><article key='1'><author>A</author><author>B</author><title>T</title><year>2001</year><journal>J</journal><ee>https://doi.org/10.1/z</ee></article><inproceedings><author>C</author><title>U</title><year>2002</year><booktitle>P</booktitle></inproceedings></dblp>")
    got = sorted(rows(files.read(spark, dblp, "dblp")), key=lambda r: r["year"])
    assert got[0]["authors"] == "A; B" and got[0]["doi"] == "10.1/z" and got[1]["source"] == "P"
    en = put("e.xml", "<xml><records><record><titles><title>T1</title><secondary-title>J</secondary-title></titles><contributors><authors><author>A</author><author>B</author></authors></contributors><dates><year>2001</year></dates></record></records></xml>")
    assert rows(files.read(spark, en, "endnote"))[0]["authors"] == "A; B"
    with pytest.raises(ValueError):
        files.read(spark, "x.abc", "nowhere")


def test_schema(spark):
    df = spark.createDataFrame([(1, "a", 2)], "`Source title` int, EID string, `Cited by` int")
    assert schema.detect_database(df) == "scopus" and schema.column(df, "cited_by") == "Cited by"
    assert schema.standardise(df).columns == ["source", "EID", "cited_by"]
    with pytest.raises(KeyError):
        schema.column(df, "doi")
    with pytest.raises(KeyError):
        schema.require(df, ["nothing"])


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'A & "b"'), ("b", "B<")], "node string, label string")
    edges = spark.createDataFrame([("a", "b", 3)], "a string, b string, n int")
    import xml.etree.ElementTree as ET

    for kind in ("graphml", "gexf", "pajek", "vosviewer"):
        sinks.graph(nodes, edges, str(tmp_path / kind), kind)
    text = lambda k: "".join(p.read_text() for p in sorted((tmp_path / k).glob("part*")))
    g = ET.fromstring(text("graphml"))
    assert len(list(g.iter("{http://graphml.graphdrawing.org/xmlns}node"))) == 2 and len(list(g.iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 1
    assert len(list(ET.fromstring(text("gexf")).iter("{http://gexf.net/1.3}edge"))) == 1
    assert text("pajek").splitlines() == ["*Vertices 2", "1 \"A & 'b'\"", '2 "B<"', "*Edges", "1 2 3"]
    assert text("vosviewer/network").strip() == "1\t2\t3"
    with pytest.raises(ValueError):
        sinks.graph(nodes, edges, str(tmp_path / "no"), "no")
    sinks.table(spark.createDataFrame([(1, ["a", "b"])], "x int, l array<string>"), str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["l"] == "a; b"


def test_api(spark):
    assert api.filter_string({"type": ["a", "b"], "is_oa": True, "year": 2001}) == "type:a|b,is_oa:true,year:2001"
    df = api.paged(spark, lambda p: [{"id": 10 * p + k, "t": "x"} for k in range(3)], 4, "id long, t string")
    assert sorted(r["id"] for r in df.collect()) == [10 * p + k for p in range(4) for k in range(3)]
    keys = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "doi string")
    assert sorted(r["doi"] for r in api.keyed(keys, "doi", lambda ks: [{"doi": k, "n": 1} for k in ks], "doi string, n int").collect()) == ["a", "b"]


def test_corpus(spark, sf):
    from folioscope.sources.adapters import publications

    c = Corpus(publications(spark, sf))
    some = c.filter(years=(1996, 1998), authors=["Supplier#000000001"], min_citations=10)
    assert some.df.count() == c.df.where("year BETWEEN 1996 AND 1998 AND array_contains(authors, 'Supplier#000000001') AND cited_by >= 10").count()
    assert c.where({"source": {"regex_include": ["^build", "mach"], "exclude": ["MACHINERY"]}, "year": {"min": 1997}}).df.select("source").distinct().collect() == [("BUILDING",)]
    assert c.removed(some).count() == c.df.count() - some.df.count()
    assert c.bradford([1]).df.select("source").distinct().count() == 2
    assert c.count("authors").count() == c.items("authors").select("item").distinct().count()

    @register_analysis("size")
    def size(corpus, more=0):
        return corpus.df.count() + more

    assert c.run("size", more=1) == c.df.count() + 1
    with pytest.raises(KeyError):
        c.run("nothing")
    g = c.groups("countries")
    assert g.intersections().where("a = b").agg(F.sum("n")).first()[0] == g.members.count()
    assert c.labels().count() == c.df.count() and c.compare_means("price", "category")["test"] in ("anova", "kruskal")


def test_pubmed_summary(spark, put):
    text = "1: Doe J, Roe R. A title of\nthings. J Test. 2001 May;3(2):1-9. doi: 10.1000/x1. PMID: 77.\n\n2: Poe P. Other title? J Two. 1999.\n"
    got = sorted(rows(files.read(spark, put("s.txt", text), "pubmed", "summary")), key=lambda r: r["year"])
    assert got[1] == {"authors": "Doe J; Roe R", "title": "A title of things", "source": "J Test", "year": "2001", "pmid": "77", "doi": "10.1000/x1"}
    assert got[0]["title"] == "Other title?" and got[0]["pmid"] is None


def test_run_all(spark, sf):
    from folioscope.sources.adapters import publications

    tables, errors = Corpus(publications(spark, sf, "authors", "countries")).run_all()
    assert "count_authors" in tables and "main_info" in tables and not errors
    tables, errors = Corpus(publications(spark, sf, "keywords")).run_all()
    assert "collaboration" in errors and tables["count_keywords"].count() > 0


@pytest.mark.parametrize(
    "db,header,cited",
    [
        ("scopus", ["EID", "Cited by", "Author Keywords"], "Cited by"), ("openalex", ["id", "doi", "display_name", "cited_by_count"], "cited_by_count"), ("pubmed", ["PMID", "ArticleTitle"], None),
        ("lens", ["Lens ID", "Scholarly Citations"], "Scholarly Citations"), ("dimensions", ["Publication ID", "FOR (ANZSRC 2020)", "Times cited"], "Times cited"), ("wos", ["UT", "TC", "AU"], "TC"),
        ("unknown", ["name", "value"], None), ("unknown", ["EID", "ut"], None),
    ],
)
def test_headers_of_vendors(spark, db, header, cited):
    df = spark.createDataFrame([tuple("x" * len(header))], header)
    assert schema.detect_database(df) == db and schema.column(df, "cited_by", False) == cited
    lower = df.toDF(*(c.lower() if len(c) > 2 else c for c in header))
    assert schema.detect_database(lower) == db
    assert "index_keywords" not in schema.standardise(df).columns
