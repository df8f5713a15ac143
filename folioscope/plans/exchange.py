"""Queries: exports that are written and read back, strings, filters, merging of sources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import strings
from folioscope.operators import lookup, quality
from folioscope.operators import cooccurrence as co
from folioscope.plans.registry import query
from folioscope.schema import detect_database, standardise
from folioscope.sources import connector, files, sinks
from folioscope.sources.adapters import PUBS, publications, table


def _folder(spark, name: str) -> str:
    """A new folder beside the checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/folioscope-exchange"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _records(s, d):
    """Publications with a title, a DOI and sorted lists as text."""
    t = publications(s, d, "authors", "keywords")
    lists = {c: F.coalesce(F.array_join(c, "; "), F.lit("")) for c in ("authors", "keywords")}
    return t.withColumns({**lists, "title": F.concat(F.lit("Paper "), "doc_id", F.lit(" on "), F.lower("source"), F.lit(", part {b}"), F.col("doc_id") % 7), "doi": F.concat(F.lit("10.1000/x"), "doc_id"), "year": F.col("year").cast("string")})


_REC = f"""WITH {PUBS}, rec AS (SELECT doc_id, 'Paper ' || doc_id || ' on ' || lower(source) || ', part {{b}}' || doc_id % 7 AS title, '10.1000/x' || doc_id AS doi, year::VARCHAR AS year, source, cited_by,
  (SELECT string_agg(item, '; ' ORDER BY item) FROM authors a WHERE a.doc_id = pubs.doc_id) AS authors, (SELECT string_agg(item, '; ' ORDER BY item) FROM keywords k WHERE k.doc_id = pubs.doc_id) AS author_keywords FROM pubs)"""


def _lines(*parts):
    return F.concat_ws("\n", *parts)


def _many(tag: str, column: str):
    """A line for each item of a list."""
    return F.nullif(F.concat_ws("\n", F.transform(F.filter(F.split(column, "; "), lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))), F.lit(""))


def _wrapped(tag: str, column: str, indent: str):
    """The items below each other, continued lines indented."""
    return F.concat(F.lit(tag), F.replace(F.col(column), F.lit("; "), F.lit(f"\n{indent}")))


def _one(tag: str, column: str):
    return F.concat(F.lit(tag), F.col(column))


def _read_back(s, d, name: str, db: str, kind: str, body, columns: list[str]):
    path = _folder(s, name)
    _records(s, d).select(body().alias("value")).write.text(path)
    return files.read(s, path, db, kind).select(*columns)


_RIS = lambda: _lines(F.lit("TY  - JOUR"), _one("TI  - ", "title"), _many("AU  - ", "authors"), F.concat(F.lit("PY  - "), "year", F.lit("/03/01")), _one("JO  - ", "source"), _many("KW  - ", "keywords"), _one("DO  - ", "doi"), F.lit("ER  - \n"))
_NBIB = lambda: _lines(F.concat(F.lit("PMID- "), F.col("doc_id")), F.concat(F.lit("TI  - "), F.replace(F.col("title"), F.lit(" on "), F.lit("\n      on "))), _many("FAU - ", "authors"), F.concat(F.lit("DP  - "), "year", F.lit(" Mar")), _one("JT  - ", "source"), _many("OT  - ", "keywords"), F.concat(F.lit("AID - "), "doi", F.lit(" [doi]\n")))
_WOS = lambda: _lines(F.lit("PT J"), _wrapped("AU ", "authors", "   "), F.concat(F.lit("TI "), F.replace(F.col("title"), F.lit(" on "), F.lit("\n   on "))), _one("SO ", "source"), _one("PY ", "year"), F.concat(F.lit("TC "), F.col("cited_by")), _one("DI ", "doi"), F.lit("ER\n"))
_BIB = lambda: F.concat(F.lit("@article{k"), "doc_id", F.lit(",\n  title = {"), "title", F.lit("},\n  author = {"), F.replace(F.col("authors"), F.lit("; "), F.lit(" and ")), F.lit('},\n  journal = "'), "source", F.lit('", year = '), "year", F.lit(", doi={"), "doi", F.lit("}, keywords={"), F.replace(F.col("keywords"), F.lit("; "), F.lit(", ")), F.lit("}}\n"))

_FOUR = "title, year, source, doi, nullif(coalesce(authors, ''), '') AS authors"
query("read_ris", lambda s, d: _read_back(s, d, "ris", "scopus", "ris", _RIS, ["title", "year", "source", "doi", "authors", "author_keywords"]), f"{_REC} SELECT {_FOUR}, author_keywords FROM rec")
query("read_medline", lambda s, d: _read_back(s, d, "nbib", "pubmed", "nbib", _NBIB, ["pmid", "title", "year", "source", "doi", "authors", "author_keywords"]), f"{_REC} SELECT doc_id::VARCHAR AS pmid, {_FOUR}, author_keywords FROM rec")
query("read_wos_text", lambda s, d: _read_back(s, d, "wos", "wos", "txt", _WOS, ["title", "year", "source", "doi", "authors", "cited_by"]), f"{_REC} SELECT {_FOUR}, cited_by::VARCHAR AS cited_by FROM rec")
query("read_bibtex", lambda s, d: _read_back(s, d, "bib", "ieee", "bib", _BIB, ["title", "year", "source", "doi", "authors", "author_keywords"]), f"{_REC} SELECT replace(replace(title, '{{', ''), '}}', '') AS title, year, source, doi, coalesce(authors, '') AS authors, coalesce(author_keywords, '') AS author_keywords FROM rec")


def _csv(s, d):
    path = _folder(s, "csv")
    sinks.table(publications(s, d, "authors", "keywords").select(F.col("doc_id").alias("EID"), F.col("source").alias("Source title"), F.col("cited_by").alias("Cited by"), F.col("authors").alias("Authors"), F.col("keywords").alias("Author Keywords"), F.concat(F.lit('a "quoted", title\nin two lines '), "doc_id").alias("Title")), path, "csv")
    return files.read(s, path, "scopus", "csv").select("EID", "source", "cited_by", "authors", "author_keywords", "title")


query("read_csv", _csv, f"""{_REC} SELECT doc_id::VARCHAR AS "EID", source, cited_by::VARCHAR AS cited_by, authors, author_keywords, 'a "quoted", title' || chr(10) || 'in two lines ' || doc_id AS title FROM rec""")


def _json(s, d):
    path = _folder(s, "json")
    t = publications(s, d, "authors")
    sinks.table(t.select(F.concat(F.lit("W"), "doc_id").alias("id"), F.col("year").alias("publication_year"), F.col("cited_by").alias("cited_by_count"), F.transform("authors", lambda x: F.struct(x.alias("display_name"))).alias("authors"), F.struct(F.col("source").alias("display_name")).alias("source")), path, "json")
    return files.read(s, path, "openalex", "json").select("id", "year", "cited_by", "authors", "source")


query("read_json", _json, f"{_REC} SELECT 'W' || doc_id AS id, year::BIGINT AS year, cited_by::BIGINT AS cited_by, authors, source FROM rec")
for _kind in ("parquet", "orc"):

    def _columnar(s, d, kind=_kind):
        path = _folder(s, kind)
        sinks.table(publications(s, d, "authors"), path, kind)
        return s.read.format(kind).load(path).select("doc_id", "year", F.array_join("authors", "; ").alias("authors"), "cited_by")

    query(f"export_{_kind}", _columnar, f"{_REC} SELECT doc_id, year::BIGINT AS year, authors, cited_by FROM rec")



#: What stands before and after the records of a file, and between them.
_AROUND = {"crossref": ('{"message": {"items": [', "]}}"), "orcid": ('{"group": [', "]}"), "endnote": ("<xml><records>", "</records></xml>"), "dblp": ("<dblp>", "</dblp>"), "zotero": ('<rdf:RDF xmlns:rdf="r" xmlns:bib="b" xmlns:dc="d" xmlns:dcterms="t" xmlns:foaf="f">', "</rdf:RDF>")}
#: Records of a JSON message: the services answer with pages of a thousand at most.
_PAGE = 1000


def _written(s, d, name: str, db: str, kind: str, value, columns: list[str]):
    """Publications written as text and read back: a row for each record, XML with its opening and closing tags in each task's file, JSON in messages of a thousand records, one a line."""
    path = _folder(s, name)
    lines = _records(s, d).where("authors <> ''").select(value.alias("value"))
    if name in _AROUND:
        lines = lines.mapInArrow(_pages(*_AROUND[name]) if kind == "json" else _document(*_AROUND[name]), "value string")
    lines.write.text(path)
    return files.read(s, path, db, kind, **({"lines": True} if kind == "json" else {})).select(*columns)


def _document(opening: str, closing: str):
    """A task's records as they come, between what opens and closes a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"value": [opening]})
        yield from batches
        yield pa.record_batch({"value": [closing]})

    return run


def _pages(opening: str, closing: str):
    """A task's records in messages of _PAGE at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _PAGE):
                yield pa.record_batch({"value": [opening + ",".join(batch["value"].slice(at, _PAGE).to_pylist()) + closing]})

    return run


def _tagged(tag: str, column):
    return F.concat(F.lit(f"<{tag}>"), column, F.lit(f"</{tag}>"))


def _each(tag: str, column: str):
    return F.array_join(F.transform(F.split(column, "; "), lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), "")


def _endnote():
    """A record with styled text in the title."""
    inner = [_tagged("titles", F.concat(_tagged("title", F.concat(F.lit("<![CDATA[<style>"), "title", F.lit("</style>]]>"))), _tagged("secondary-title", F.col("source")))), _tagged("contributors", _tagged("authors", _each("author", "authors"))), _tagged("dates", _tagged("year", F.col("year"))), _tagged("keywords", _each("keyword", "keywords")), _tagged("electronic-resource-num", F.col("doi"))]
    return _tagged("record", F.concat(*inner))


def _dblp():
    kind = F.when(F.col("doc_id") % 2 == 0, "article").otherwise("inproceedings")
    where = F.when(F.col("doc_id") % 2 == 0, _tagged("journal", F.col("source"))).otherwise(_tagged("booktitle", F.col("source")))
    return F.concat(F.lit("<"), kind, F.lit(">"), _each("author", "authors"), _tagged("title", F.col("title")), _tagged("year", F.col("year")), where, _tagged("ee", F.concat(F.lit("https://doi.org/"), "doi")), F.lit("</"), kind, F.lit(">"))


def _crossref():
    people = F.transform(F.split("authors", "; "), lambda x: F.struct(F.substring_index(x, "#", -1).alias("given"), F.substring_index(x, "#", 1).alias("family")))
    date = F.array(F.array(F.col("year").cast("int"), F.lit(3)))
    return F.to_json(F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title"), people.alias("author"), F.struct(date.alias("date-parts")).alias("issued"), F.array("source").alias("container-title"), F.col("cited_by").cast("long").alias("is-referenced-by-count"), F.lit("journal-article").alias("type")))


def _orcid():
    ids = F.array(F.struct(F.lit("issn").alias("external-id-type"), F.lit("1234").alias("external-id-value")), F.struct(F.lit("doi").alias("external-id-type"), F.col("doi").alias("external-id-value")))
    value = lambda c: F.struct(c.alias("value"))
    work = F.struct(F.struct(value(F.col("title")).alias("title")).alias("title"), F.struct(value(F.col("year")).alias("year")).alias("publication-date"), value(F.col("source")).alias("journal-title"), F.lit("journal-article").alias("type"), F.struct(ids.alias("external-id")).alias("external-ids"))
    return F.to_json(F.struct(F.array(work).alias("work-summary")))


def _zotero():
    people = F.array_join(F.transform(F.split("authors", "; "), lambda x: F.concat(F.lit("<rdf:li><foaf:Person><foaf:surname>"), F.substring_index(x, "#", 1), F.lit("</foaf:surname><foaf:givenName>"), F.substring_index(x, "#", -1), F.lit("</foaf:givenName></foaf:Person></rdf:li>"))), "")
    return _tagged("bib:Article", F.concat(_tagged("dc:title", F.col("title")), _tagged("dc:date", F.concat(F.lit("3 March "), "year")), _tagged("dcterms:abstract", F.col("source")), _tagged("bib:authors", _tagged("rdf:Seq", people))))


def _summary():
    return F.concat("doc_id", F.lit(": "), F.replace(F.col("authors"), F.lit("; "), F.lit(", ")), F.lit(". "), F.replace("title", F.lit(", part"), F.lit("\npart")), F.lit(". "), "source", F.lit(". "), "year", F.lit(" Mar;3(1):5. doi: "), "doi", F.lit(". PMID: "), "doc_id", F.lit("\n"))


_SOME = "FROM rec WHERE authors IS NOT NULL"
query("read_endnote_xml", lambda s, d: _written(s, d, "endnote", "endnote", "xml", _endnote(), ["title", "source", "authors", "year", "author_keywords", "doi"]), f"{_REC} SELECT title, source, authors, year, author_keywords, doi {_SOME}")
query("read_dblp_xml", lambda s, d: _written(s, d, "dblp", "dblp", "xml", _dblp(), ["title", "source", "authors", "year", "doi", "document_type"]), f"{_REC} SELECT title, source, authors, year, doi, CASE WHEN doc_id % 2 = 0 THEN 'article' ELSE 'inproceedings' END AS document_type {_SOME}")
query("read_crossref", lambda s, d: _written(s, d, "crossref", "crossref", "json", _crossref(), ["doi", "title", "authors", "year", "source", "cited_by", "document_type"]), f"{_REC} SELECT doi, title, replace(authors, '#', ', ') AS authors, year::BIGINT AS year, source, cited_by, 'journal-article' AS document_type {_SOME}")
query("read_orcid", lambda s, d: _written(s, d, "orcid", "orcid", "json", _orcid(), ["title", "year", "source", "document_type", "doi"]), f"{_REC} SELECT title, year, source, 'journal-article' AS document_type, doi {_SOME}")
query("read_zotero_rdf", lambda s, d: _written(s, d, "zotero", "zotero", "rdf", _zotero(), ["title", "authors", "year", "abstract"]), f"{_REC} SELECT title, replace(authors, '#', ', ') AS authors, year, source AS abstract {_SOME}")
query("read_pubmed_summary", lambda s, d: _written(s, d, "summary", "pubmed", "summary", _summary(), ["title", "authors", "source", "year", "pmid", "doi"]), f"{_REC} SELECT replace(title, ', part', ' part') AS title, authors, source, year, doc_id::VARCHAR AS pmid, doi {_SOME}")
query("read_id_list", lambda s, d: _written(s, d, "ids", "pubmed", "ids", F.concat(F.lit(" "), "doc_id", F.lit(" ")), ["pmid"]), f"{_REC} SELECT doc_id::VARCHAR AS pmid {_SOME}")

# graphs as files ------------------------------------------------------------------------------------------------------


def _graph(s, d, kind: str):
    """The keyword graph's file, written and read back, its lines counted."""
    edges = co.cooccurrence(publications(s, d, "keywords"), "keywords")
    nodes = co.margins(publications(s, d, "keywords"), "keywords").select(F.col("item").alias("node"), F.concat(F.lit("<"), "item", F.lit(">")).alias("label"))
    path = _folder(s, kind)
    sinks.graph(nodes, edges, path, kind)
    got = s.read.text(f"{path}/*" if kind == "vosviewer" else path)
    return got.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_G = f"WITH {PUBS}, e AS (SELECT x.item AS a, y.item AS b, count(*)::VARCHAR AS n FROM keywords x JOIN keywords y ON x.doc_id = y.doc_id AND x.item < y.item GROUP BY x.item, y.item), v AS (SELECT item AS node, row_number() OVER (ORDER BY item) AS i FROM (SELECT DISTINCT item FROM keywords))"
_LINES = {
    "pajek": """SELECT '*Vertices ' || count(*) AS line FROM v UNION ALL SELECT i || ' "<' || node || '>"' FROM v UNION ALL SELECT '*Edges' UNION ALL SELECT x.i || ' ' || y.i || ' ' || n FROM e JOIN v x ON x.node = a JOIN v y ON y.node = b""",
    "vosviewer": "SELECT i || chr(9) || '<' || node || '>' AS line FROM v UNION ALL SELECT x.i || chr(9) || y.i || chr(9) || n FROM e JOIN v x ON x.node = a JOIN v y ON y.node = b",
    "graphml": """SELECT '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="l" for="node" attr.name="label" attr.type="string"/><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">' AS line UNION ALL SELECT '<node id="' || node || '"><data key="l">&lt;' || node || '&gt;</data></node>' FROM v UNION ALL SELECT '<edge source="' || a || '" target="' || b || '"><data key="w">' || n || '</data></edge>' FROM e UNION ALL SELECT '</graph></graphml>'""",
    "gexf": """SELECT '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>' AS line UNION ALL SELECT '<node id="' || node || '" label="&lt;' || node || '&gt;"/>' FROM v UNION ALL SELECT '</nodes><edges>' UNION ALL SELECT '<edge source="' || a || '" target="' || b || '" weight="' || n || '"/>' FROM e UNION ALL SELECT '</edges></graph></gexf>'""",
}
for _kind, _sql in _LINES.items():
    query(f"export_{_kind}", lambda s, d, k=_kind: _graph(s, d, k), f"{_G} SELECT line, count(*)::BIGINT AS n FROM ({_sql}) GROUP BY line")

# strings --------------------------------------------------------------------------------------------------------------


def _people(s, d):
    """Customers as authors: 'First Middle Last', 'Last, First' or 'Last, F. M.' of the words of a part's name."""
    c, p = table(s, d, "customer"), table(s, d, "part")
    n = p.count()
    t = c.join(p, F.col("c_custkey") % n == F.col("p_partkey")).select(F.col("c_custkey").alias("id"), F.initcap(F.substring_index("p_name", " ", 1)).alias("first"), F.initcap(F.substring_index("p_name", " ", -1)).alias("last"), F.initcap(F.lower("c_mktsegment")).alias("middle"))
    k = F.col("id") % 3
    return t.select("id", "first", "last", "middle", F.when(k == 0, F.concat_ws(" ", "first", "middle", "last")).when(k == 1, F.concat(F.col("last"), F.lit(", "), F.col("first"))).otherwise(F.concat(F.col("last"), F.lit(", "), F.substring("first", 1, 1), F.lit(". "), F.substring("middle", 1, 1), F.lit("."))).alias("name"))


_PPL = """WITH b AS (SELECT c_custkey AS id, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', -1) AS l, lower(c_mktsegment) AS m FROM customer JOIN part ON c_custkey % (SELECT count(*) FROM part) = p_partkey),
q AS (SELECT id, upper(f[1]) || f[2:] AS first, upper(l[1]) || l[2:] AS last, upper(m[1]) || m[2:] AS middle FROM b),
ppl AS (SELECT *, CASE id % 3 WHEN 0 THEN first || ' ' || middle || ' ' || last WHEN 1 THEN last || ', ' || first ELSE last || ', ' || first[1] || '. ' || middle[1] || '.' END AS name FROM q)"""
query("author_names", lambda s, d: _people(s, d).select("id", strings.author_parts(F.col("name")).alias("p"), strings.short_author(F.col("name")).alias("short")).select("id", "p.last", "p.first", "p.initials", "short"), _PPL + """
SELECT id, last, CASE id % 3 WHEN 0 THEN first || ' ' || middle WHEN 1 THEN first ELSE first[1] || '. ' || middle[1] || '.' END AS first, CASE WHEN id % 3 = 1 THEN first[1] ELSE first[1] || middle[1] END AS initials, CASE WHEN id % 3 = 0 THEN name ELSE last || ', ' || first[1] || '.' END AS short FROM ppl""")
query("name_similarity", lambda s, d: _people(s, d).select("id", strings.bigram_similarity(F.lower("first"), F.lower("middle")).alias("similarity")), _PPL + """, g AS (SELECT id, list_distinct(list_transform(range(1, length(first)), lambda i: lower(first)[i:i + 1])) AS a, list_distinct(list_transform(range(1, length(middle)), lambda i: lower(middle)[i:i + 1])) AS b FROM ppl)
SELECT id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS similarity FROM g""", "similarity")


def _cited(s, d):
    """Reference strings with some of their parts."""
    k = F.col("id") % 4
    year = (F.lit(1980) + F.col("id") % 40).cast("string")
    t = _people(s, d)
    return t.select("id", F.concat(F.col("last"), F.lit(", "), F.substring("first", 1, 1), F.lit(". ("), year, F.lit(") A title "), F.lower("middle"), F.lit(". Journal, "), F.when(k == 0, F.concat(F.lit("vol. "), F.col("id").cast("string"), F.lit(", pp. 12-34"))).when(k == 1, F.concat(F.lit("doi 10.1234/AB."), F.col("id").cast("string"), F.lit("."))).when(k == 2, F.concat(F.lit("PMID: "), F.col("id").cast("string"))).otherwise("")).alias("r"))


_CIT = _PPL + ", cit AS (SELECT *, id % 4 AS k, 1980 + id % 40 AS y FROM ppl)"
query("reference_parts", lambda s, d: _cited(s, d).select("id", strings.reference_parts(F.col("r")).alias("p")).select("id", "p.*"), _CIT + """
SELECT id, y::BIGINT AS year, CASE WHEN k = 1 THEN '10.1234/ab.' || id END AS doi, CASE WHEN k = 2 THEN id::VARCHAR END AS pmid, CASE WHEN k = 0 THEN id::VARCHAR END AS volume, CASE WHEN k = 0 THEN '12-34' END AS pages, last || ', ' || first[1] || '.' AS first_author, 'A title ' || lower(middle) AS title FROM cit""")
query("reference_dois", lambda s, d: _cited(s, d).select("id", F.array_join(strings.reference_dois(F.concat(F.col("r"), F.lit("; 10.5555/Zz); again 10.5555/zz"))), " ").alias("dois")), _CIT + " SELECT id, CASE WHEN k = 1 THEN '10.1234/ab.' || id || ' ' ELSE '' END || '10.5555/zz' AS dois FROM cit")


def _addresses(s, d):
    c = publications(s, d, "base")
    return c.select("doc_id", F.concat(F.lit("Doe J.; Street "), "doc_id", F.lit(", City, "), F.lower("ca_country"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("; email: a.b"), "doc_id", F.lit("@mail.uni-x."), F.element_at(F.array(F.lit("si"), F.lit("org")), (F.col("doc_id") % 4 / 2).cast("int") + 1))).otherwise(".")).alias("a"))


query("correspondence_parts", lambda s, d: _addresses(s, d).select("doc_id", strings.ca_country(F.col("a")).alias("country"), strings.mail_domain(F.col("a")).alias("domain")), f"WITH {PUBS} SELECT doc_id, lower(ca_country) AS country, CASE doc_id % 4 WHEN 0 THEN 'si' WHEN 2 THEN 'org' END AS domain FROM pubs")
query("normal_dois", lambda s, d: publications(s, d, "base").select("doc_id", strings.normal_doi(F.concat(F.element_at(F.array(F.lit(" https://doi.org/"), F.lit("http://dx.doi.org/"), F.lit("DOI: "), F.lit("x")), (F.col("doc_id") % 4).cast("int") + 1), F.lit("10.5/AbC"), "doc_id", F.lit(" "))).alias("doi")), f"WITH {PUBS} SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '10.5/abc' || doc_id END AS doi FROM pubs")
query("clean_keywords", lambda s, d: publications(s, d, "keywords", "types").where("keywords IS NOT NULL").select("doc_id", F.array_join(strings.keywords(F.concat("keywords", F.transform("types", lambda x: F.concat(F.lit("Type-_"), x))), {"brand2": "first brand", "type economy": "cheap"}, ["brand3", "type small"]), "|").alias("k")), f"WITH {PUBS}, x AS (SELECT doc_id, replace(lower(item), '#', '') AS k FROM keywords UNION SELECT doc_id, 'type ' || lower(item) FROM types) SELECT doc_id, coalesce(string_agg(DISTINCT CASE k WHEN 'brand2' THEN 'first brand' WHEN 'type economy' THEN 'cheap' ELSE k END, '|' ORDER BY CASE k WHEN 'brand2' THEN 'first brand' WHEN 'type economy' THEN 'cheap' ELSE k END) FILTER (k NOT IN ('brand3', 'type small')), '') AS k FROM x GROUP BY doc_id")
query("clean_texts", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(strings.clean_text(F.col("text"), ["the", "and", "of"])).alias("h")), r"SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'of')), ' ')) AS h FROM documents")
query("links_in_texts", lambda s, d: _people(s, d).select("id", F.array_join(strings.repository_links(F.concat(F.lit("see https://github.com/"), F.col("last"), F.lit("/x, and (zenodo.org/record/"), F.col("id"), F.lit("). Not example.org/a; https://github.com/"), F.col("last"), F.lit("/x"))), " ").alias("links")), _PPL + " SELECT id, 'https://github.com/' || last || '/x zenodo.org/record/' || id AS links FROM ppl")
query("combined_texts", lambda s, d: _records(s, d).select("doc_id", F.concat_ws(" ", "title", "source", F.nullif("keywords", F.lit(""))).alias("text")), f"{_REC} SELECT doc_id, concat_ws(' ', title, source, author_keywords) AS text FROM rec")

# names, filters, lookups ----------------------------------------------------------------------------------------------


def _mapping(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("variant"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("canonical"))


query("mapped_names", lambda s, d: lookup.mapped(publications(s, d, "countries").where("countries IS NOT NULL"), "countries", _mapping(s, d)).select("doc_id", F.array_join(F.array_sort("countries"), "; ").alias("regions")), f"WITH {PUBS} SELECT doc_id, string_agg(DISTINCT 'region ' || n_regionkey, '; ' ORDER BY 'region ' || n_regionkey) AS regions FROM countries JOIN nation ON n_name = item GROUP BY doc_id")
query("standard_columns", lambda s, d: standardise(publications(s, d, "base").select(F.col("doc_id").alias("EID"), F.col("source").alias("SOURCE TITLE"), F.col("cited_by").alias("cited BY"), F.col("year").alias("Year"))).select("EID", "source", "cited_by", "year"), f'WITH {PUBS} SELECT doc_id AS "EID", source, cited_by, year::BIGINT AS year FROM pubs')
_EXPORTS = {
    "scopus": ("orders", ["EID", "Cited by", "Author Keywords"]), "openalex": ("part", ["id", "doi", "display_name"]), "pubmed": ("customer", ["PMID", "ArticleTitle"]), "lens": ("supplier", ["Lens ID", "Scholarly Citations"]),
    "dimensions": ("nation", ["Publication ID", "FOR (ANZSRC 2020)"]), "wos": ("lineitem", ["UT", "TC"]), "unknown": ("region", ["a", "b"]),
}


def _detected(s, d):
    """Records of each table under an export's column names, by the database that these names show."""
    out = None
    for name, header in _EXPORTS.values():
        t = table(s, d, name)
        t = t.select(*(F.col(c).alias(x) for c, x in zip(t.columns, header, strict=False)))
        one = t.agg(F.count("*").alias("n")).select(F.lit(detect_database(t)).alias("db"), "n")
        out = one if out is None else out.union(one)
    return out


query("detected_databases", _detected, " UNION ALL ".join(f"SELECT '{db}' AS db, count(*)::BIGINT AS n FROM {name}" for db, (name, _) in _EXPORTS.items()))


# sources and variants -------------------------------------------------------------------------------------------------


def _sources(s, d):
    """Three overlapping databases: by DOI, by title only, with more or fewer citations."""
    t = _records(s, d).withColumn("keywords", F.array("source"))
    some = lambda k, cite, doi: t.where(F.col("doc_id") % k == 0).select("doc_id", F.when(F.lit(doi), F.col("doi")).alias("doi"), "title", (F.col("cited_by") + cite).alias("cited_by"), F.array(F.concat(F.lit(f"k{k} "), "source")).alias("keywords"))
    return {"one": some(2, 0, True), "two": some(3, 5, True), "three": some(5, -3, False)}


_SRC = f"""{_REC}, m AS (SELECT doc_id, title, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN doi END AS doi, cited_by + CASE WHEN doc_id % 3 = 0 THEN 5 WHEN doc_id % 2 = 0 THEN 0 ELSE -3 END AS cited_by,
  list_filter([CASE WHEN doc_id % 2 = 0 THEN 'one' END, CASE WHEN doc_id % 5 = 0 THEN 'three' END, CASE WHEN doc_id % 3 = 0 THEN 'two' END], lambda x: x IS NOT NULL) AS sources,
  list_filter([CASE WHEN doc_id % 2 = 0 THEN 'k2 ' || source END, CASE WHEN doc_id % 3 = 0 THEN 'k3 ' || source END, CASE WHEN doc_id % 5 = 0 THEN 'k5 ' || source END], lambda x: x IS NOT NULL) AS keywords FROM rec WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0)"""
query("merged_sources", lambda s, d: quality.merge_sources(_sources(s, d), ["one", "two", "three"]).select("doc_id", "title", "doi", "cited_by", F.array_join("keywords", ";").alias("keywords"), F.array_join("sources", ";").alias("sources"), "n_records"), f"{_SRC} SELECT doc_id, title, doi, cited_by::BIGINT AS cited_by, array_to_string(keywords, ';') AS keywords, array_to_string(sources, ';') AS sources, len(sources)::BIGINT AS n_records FROM m")
query("source_overlap", lambda s, d: quality.source_overlap(quality.merge_sources(_sources(s, d), ["one", "two", "three"])), f"{_SRC}, x AS (SELECT doc_id, unnest(sources) AS s FROM m) SELECT p.s AS a, q.s AS b, count(*)::BIGINT AS n FROM x p JOIN x q ON p.doc_id = q.doc_id GROUP BY ALL")


def _names(s, d):
    return _people(s, d).groupBy("name").agg(F.count("*").alias("n"))


_BG = "list_distinct(list_transform(range(1, length({0})), lambda i: {0}[i:i + 1]))"
query("author_variants", lambda s, d: quality.author_variants(_names(s, d)), f"""WITH RECURSIVE {_PPL[5:]}, nm AS (SELECT name, any_value(lower(last)) AS last, any_value(CASE WHEN id % 3 = 1 THEN first[1] ELSE first[1] || middle[1] END) AS i, lower(any_value(name)) AS low, count(*)::BIGINT AS n FROM ppl GROUP BY name),
  gr AS (SELECT *, {_BG.format("low")} AS g FROM nm), lk AS (SELECT x.name AS a, y.name AS b FROM gr x JOIN gr y ON x.name <> y.name AND ((x.last = y.last AND (starts_with(x.i, y.i) OR starts_with(y.i, x.i))) OR (x.low[1] = y.low[1] AND len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g)))::DOUBLE >= 0.85))),
  r AS (SELECT name, name AS o FROM nm UNION SELECT r.name, lk.b FROM r JOIN lk ON r.o = lk.a), c AS (SELECT name, min(o) AS c FROM r GROUP BY name), k AS (SELECT c, min_by(name, (-n, name)) AS canonical FROM c JOIN nm USING (name) GROUP BY c)
SELECT name, canonical, n FROM c JOIN nm USING (name) JOIN k USING (c)""")


def _titled(s, d):
    """Documents under the first forty letters of their texts, in made-up years."""
    return table(s, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("year"), F.substring(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), 1, 40).alias("title"))


_TTL = r"WITH t AS (SELECT doc_id, doc_id % 3 AS year, trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', '', 'g')[1:40], '\s+', ' ', 'g')) AS t FROM documents)"
query("similar_titles", lambda s, d: quality.similar_titles(_titled(s, d), 0.6), f"""{_TTL}, u AS (SELECT year, t, min(doc_id) AS k FROM t WHERE length(t) >= 10 GROUP BY ALL), g AS (SELECT *, {_BG.format("t")} AS g FROM u),
p AS (SELECT x.k AS a, y.k AS b, len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g)))::DOUBLE AS similarity FROM g x JOIN g y ON x.year = y.year AND x.k < y.k)
SELECT * FROM p WHERE similarity >= 0.6 UNION ALL SELECT k, doc_id, 1.0::DOUBLE FROM t JOIN u ON u.year = t.year AND u.t = t.t WHERE doc_id <> k""", "similarity")

# filters --------------------------------------------------------------------------------------------------------------

query("filtered", lambda s, d: Corpus(publications(s, d, "authors", "keywords", "countries")).filter(years=(1996, 1999), sources=["BUILDING", "MACHINERY"], keywords=["Brand#2", "Brand#7"], min_citations=60).df.select("doc_id"), f"WITH {PUBS} SELECT doc_id FROM pubs WHERE year BETWEEN 1996 AND 1999 AND source IN ('BUILDING', 'MACHINERY') AND cited_by >= 60 AND doc_id IN (SELECT doc_id FROM keywords WHERE item IN ('Brand#2', 'Brand#7'))")
query("filtered_by_rules", lambda s, d: Corpus(publications(s, d, "base")).where({"category": {"regex_include": ["urgent", "^2"], "regex_exclude": ["^9"]}, "source": {"exclude": ["BUILDING"]}, "cited_by": {"min": 20, "max": 150}}).df.select("doc_id"), f"WITH {PUBS} SELECT doc_id FROM pubs WHERE regexp_matches(lower(category), 'urgent|^2') AND source <> 'BUILDING' AND cited_by BETWEEN 20 AND 150")
query("filtered_by_bradford", lambda s, d: Corpus(publications(s, d, "base")).bradford([1, 2]).df.select("doc_id"), f"WITH {PUBS}, r AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS r, count(*) OVER () AS n FROM pubs GROUP BY source) SELECT doc_id FROM pubs WHERE source IN (SELECT source FROM r WHERE least(3, (r - 1) * 3 // n + 1) <= 2)")
query("labels_of_documents", lambda s, d: Corpus(publications(s, d, "authors")).labels().select("doc_id", "short"), f"WITH {PUBS} SELECT doc_id, coalesce((SELECT min(item) FROM authors a WHERE a.doc_id = pubs.doc_id), 'Anonymous') || ' (' || year || ')' AS short FROM pubs")




def _kept(s, d, path: str, records, part: str, values: list):
    """The records written as a service's pages, and the service over them."""
    folder = _folder(s, "pages")
    connector.keep_pages(records, part, folder, path)
    return connector.connect(s, connector.kept(folder), next(e for e in (connector.WORKS, connector.AUTHORS, connector.INSTITUTIONS) if e.path == path), values)


def _works(s, d):
    """Publications as a service's works, from 1994 on, of two types."""
    one = lambda name, value: F.struct(value.alias(name))
    person = lambda a: F.struct(F.struct(F.concat(F.lit("https://w.example/A"), F.replace(a, F.lit("#"), F.lit(""))).alias("id"), a.alias("display_name")).alias("author"), F.array(F.struct(F.col("source").alias("display_name"), F.col("ca_country").alias("country_code"))).alias("institutions"))
    record = F.struct(
        F.concat(F.lit("https://w.example/W"), "doc_id").alias("id"), F.concat(F.lit("https://doi.org/10.1/X"), "doc_id").alias("doi"), F.concat(F.lit("Work "), "doc_id").alias("display_name"), F.col("year").alias("publication_year"), F.col("cited_by").alias("cited_by_count"),
        F.lower("category").alias("type"), F.transform("authors", person).alias("authorships"), F.transform("keywords", lambda k: one("display_name", k)).alias("keywords"), F.create_map(F.lit("two"), F.array(F.lit(1)), F.lit("one"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"),
    )
    rows = publications(s, d, "authors", "keywords").where("year IS NOT NULL").select("year", record.alias("record"))
    first, last = rows.agg(F.min("year"), F.max("year")).first()
    found = _kept(s, d, "works", rows, "year", list(range(first or 0, (last or -1) + 1)))
    return found.where("year >= 1994 AND document_type IN ('1-urgent', '5-low')").select(
        "id", "doi", "title", "year", "cited_by", "document_type", F.array_join("authors", "; ").alias("authors"), F.array_join("author_ids", "; ").alias("author_ids"), F.array_join("institutions", "; ").alias("institutions"), F.array_join("countries", "; ").alias("countries"), F.array_join("keywords", "; ").alias("keywords"), "abstract"
    )


query("search_works", _works, f"""WITH {PUBS}, a AS (SELECT doc_id, string_agg(item, '; ' ORDER BY item) AS x FROM authors GROUP BY 1), k AS (SELECT doc_id, string_agg(item, '; ' ORDER BY item) AS x FROM keywords GROUP BY 1)
SELECT 'W' || doc_id AS id, '10.1/x' || doc_id AS doi, 'Work ' || doc_id AS title, year, cited_by, lower(category) AS document_type, coalesce(a.x, '') AS authors, coalesce('A' || replace(replace(a.x, '#', ''), '; ', '; A'), '') AS author_ids, CASE WHEN a.x IS NULL THEN '' ELSE source END AS institutions, CASE WHEN a.x IS NULL THEN '' ELSE ca_country END AS countries, coalesce(k.x, '') AS keywords, 'one two one' AS abstract
FROM pubs LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id) WHERE year >= 1994 AND lower(category) IN ('1-urgent', '5-low')""")


def _nations(s, d) -> list[str]:
    """Names of the table of nations: as few as there are countries."""
    return [r[0] for r in table(s, d, "nation").select("n_name").distinct().orderBy("n_name").collect()]


def _authors(s, d):
    """Customers as a service's authors, with the number and prices of their orders."""
    orders = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("works_count"), F.floor(F.max("o_totalprice")).cast("int").alias("cited_by_count"))
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, "c_custkey", "left")
    place = F.array(F.struct(F.col("c_mktsegment").alias("display_name"), F.col("n_name").alias("country_code")))
    record = F.struct(F.concat(F.lit("https://w.example/A"), "c_custkey").alias("id"), F.concat(F.lit("https://o.example/"), "c_custkey").alias("orcid"), F.col("c_name").alias("display_name"), "works_count", "cited_by_count", place.alias("last_known_institutions"))
    return _kept(s, d, "authors", rows.select("n_name", record.alias("record")), "n_name", _nations(s, d)).select("id", "orcid", "name", "works", "cited_by", F.array_join("institutions", "; ").alias("institutions"), F.array_join("countries", "; ").alias("countries"))


query("search_authors", _authors, "SELECT 'A' || c_custkey AS id, c_custkey::VARCHAR AS orcid, c_name AS name, n AS works, p AS cited_by, c_mktsegment AS institutions, n_name AS countries FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n, floor(max(o_totalprice))::BIGINT AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")


def _institutions(s, d):
    """Suppliers as a service's institutions, those of nations from J on."""
    lines = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_orderkey").alias("works_count"), F.sum("l_quantity").cast("long").alias("cited_by_count"))
    rows = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(lines, "s_suppkey", "left")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "education").otherwise("company")
    record = F.struct(F.concat(F.lit("https://w.example/I"), "s_suppkey").alias("id"), F.concat(F.lit("https://r.example/"), "s_suppkey").alias("ror"), F.col("s_name").alias("display_name"), F.col("n_name").alias("country_code"), kind.alias("type"), "works_count", "cited_by_count")
    return _kept(s, d, "institutions", rows.select("n_name", record.alias("record")), "n_name", _nations(s, d)).where("country >= 'J' AND type = 'education'")


query("search_institutions", _institutions, "SELECT 'I' || s_suppkey AS id, s_suppkey::VARCHAR AS ror, s_name AS name, n_name AS country, 'education' AS type, n AS works, q AS cited_by FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey WHERE n_name >= 'J' AND s_suppkey % 2 = 0")
