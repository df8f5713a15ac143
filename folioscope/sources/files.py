"""Readers of bibliographic exports. Each returns one row a record with list fields as '; '-joined strings, as exports keep them; `read` also maps names.

CSV, JSON and XML go through the engine's own sources. Tagged formats are split into records by the source's line separator, so a large file is read by
many tasks; fields are then taken apart by column functions. Only BibTeX, whose braces nest, is parsed by Python, record by record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.schema import standardise

NULLS = ("", "NA", "NaN", "n/a", "-", "?")

#: Tags of RIS, and of the two tagged formats, by logical name.
RIS = {"title": ("TI", "T1"), "abstract": ("AB", "N2"), "year": ("PY", "Y1"), "authors": ("AU", "A1"), "source": ("JO", "T2", "JF"), "author_keywords": ("KW",), "doi": ("DO",), "document_type": ("TY",), "language": ("LA",), "volume": ("VL",), "issue": ("IS",), "first_page": ("SP",), "last_page": ("EP",), "url": ("UR",)}
WOS = {"title": ("TI",), "abstract": ("AB",), "year": ("PY",), "authors": ("AU",), "source": ("SO",), "author_keywords": ("DE",), "index_keywords": ("ID",), "doi": ("DI",), "document_type": ("DT",), "cited_by": ("TC",), "references": ("CR",), "affiliations": ("C1",), "language": ("LA",)}
MEDLINE = {"title": ("TI",), "abstract": ("AB",), "year": ("DP",), "authors": ("FAU", "AU"), "source": ("JT", "TA"), "index_keywords": ("MH",), "author_keywords": ("OT",), "doi": ("AID", "LID"), "document_type": ("PT",), "language": ("LA",), "affiliations": ("AD",), "pmid": ("PMID",)}


def csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, all columns as strings, usual null tokens as null, quoted fields over lines."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, quote='"', escape='"', inferSchema=False)
    return df.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in df.columns))


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns that are null throughout: one aggregate over the frame."""
    n = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(f"`{c}`" for c in df.columns if n[c]))


def numeric(df: DataFrame) -> DataFrame:
    """String columns whose values are all numbers, as doubles: one aggregate over the frame."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    if not text:
        return df
    n = df.agg(*(F.sum((F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).cast("long")).alias(c) for c in text)).first()
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in text if n[c] == 0})


def _fields(record: Column, tag: str) -> Column:
    """(tag, value) of a record's lines; a line without a tag goes on with the field before."""
    joined = F.regexp_replace(record, rf"\r?\n(?!{tag})[ \t]*", " ")
    lines = F.split(joined, r"\r?\n")
    parts = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, f"^({tag})(.*)$", 2).alias("tag"), F.trim(F.regexp_extract(x, f"^{tag}(.*)$", 2)).alias("value")))
    return F.filter(parts, lambda p: p["tag"] != "")


def _mapped(records: DataFrame, tags: dict[str, tuple[str, ...]]) -> DataFrame:
    """One column for each logical name: values of its first tag that has any, joined."""
    def values(tag: str) -> Column:
        found = F.transform(F.filter("fields", lambda f: f["tag"] == tag), lambda f: f["value"])
        return F.nullif(F.array_join(F.filter(found, lambda v: v != ""), "; "), F.lit(""))

    return records.select(*(F.coalesce(*(values(t) for t in names)).alias(name) for name, names in tags.items()))


def ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS: records end with 'ER  -'; repeated tags are joined; lines without a tag go on."""
    text = spark.read.text(path, lineSep="ER  -").select(F.concat(F.lit("\n"), F.col("value")).alias("r"))
    tag = r"([A-Z][A-Z0-9])  -"
    out = _mapped(text.where(F.col("r").rlike(r"TY  -")).select(_fields(F.col("r"), tag).alias("fields")), RIS)
    return out.withColumn("year", F.nullif(F.regexp_extract("year", r"(\d{4})", 1), F.lit("")))


def medline(spark: SparkSession, path: str) -> DataFrame:
    """MEDLINE (.nbib): tags of up to four letters before '- ', continued lines are indented, records have a blank line between."""
    text = spark.read.text(path, lineSep="\n\n").select(F.concat(F.lit("\n"), F.col("value")).alias("r"))
    out = _mapped(text.where(F.col("r").rlike(r"\nPMID")).select(_fields(F.col("r"), r"([A-Z]{2,4}) *- ?").alias("fields")), MEDLINE)
    doi = F.nullif(F.regexp_extract("doi", r"(10\.\S+)\s*\[doi\]", 1), F.lit(""))
    return out.withColumns({"doi": doi, "year": F.nullif(F.regexp_extract("year", r"(\d{4})", 1), F.lit(""))})


def wos_text(spark: SparkSession, path: str) -> DataFrame:
    """Tagged text: two-letter tags, continued lines are indented, records end with ER and a blank line. Continued lines of lists are items."""
    text = spark.read.text(path, lineSep="\nER").select(F.concat(F.lit("\n"), F.regexp_replace("value", r"\n {3}", "\n-- ")).alias("r"))
    lines = F.filter(F.split(F.col("r"), r"\r?\n"), lambda x: x.rlike(r"^([A-Z][A-Z0-9]|--) "))
    step = F.aggregate(
        lines,
        F.array().cast("array<struct<tag:string,value:string>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(F.when(x.startswith("--"), F.coalesce(F.try_element_at(acc, F.lit(-1))["tag"], F.lit("--"))).otherwise(F.substring(x, 1, 2)).alias("tag"), F.trim(F.substr(x, F.lit(4))).alias("value")))),
    )
    out = _mapped(text.where(F.col("r").rlike(r"\nPT ")).select(step.alias("fields")), WOS)
    prose = [c for c in ("title", "abstract", "author_keywords", "index_keywords", "source") if c in out.columns]
    return out.withColumns({c: F.regexp_replace(c, "(?<!;); ", " ") if c in ("title", "abstract", "source") else F.regexp_replace(c, ";; ", "; ") for c in prose})


def bibtex_entries(text: str) -> Iterator[dict[str, str]]:
    """Entries with _entry_type, _citation_key and fields; braces nest, quoted values and # joins are taken as they are, broken entries end at the text's end."""
    for m in re.finditer(r"@(\w+)\s*[{(]\s*([^,\s]*)\s*,", text):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        out, at = {"_entry_type": m[1].lower(), "_citation_key": m[2]}, m.end()
        while f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at):
            at = f.end()
            if at < len(text) and text[at] in '{"':
                start, depth, quoted = at + 1, 1 if text[at] == "{" else 0, text[at] == '"'
                at += 1
                while at < len(text) and (depth or quoted):
                    c = text[at]
                    depth += (c == "{") - (c == "}")
                    if quoted and c == '"' and depth == 0:
                        quoted = False
                    at += 1
                value = text[start : at - 1]
            else:
                v = re.compile(r"[^,}\n]*").match(text, at)
                value, at = v[0], v.end()
            out[f[1].lower()] = re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip()
        yield out


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """BibTeX: a task parses the entries of its part of the file, split at '\\n@'. Entries without title and author are dropped."""
    names = ["_entry_type", "_citation_key", "title", "author", "journal", "booktitle", "year", "doi", "abstract", "keywords", "url", "volume", "number", "pages"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [e for x in pdf["value"] for e in bibtex_entries("@" + x.lstrip("@")) if e.get("title") or e.get("author")]
            yield pd.DataFrame([[e.get(n) for n in names] for e in rows], columns=names, dtype=object)

    df = spark.read.text(path, lineSep="\n@").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))
    authors = F.regexp_replace("author", r"\s+and\s+", "; ")
    return df.select("_entry_type", "_citation_key", "title", authors.alias("authors"), F.coalesce("journal", "booktitle").alias("source"), "year", "doi", "abstract", F.regexp_replace("keywords", r"\s*,\s*", "; ").alias("author_keywords"), "url", "volume", "number", "pages")


def json_records(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """JSON lines, or an array with lines=False; nested fields flattened: lists of strings joined, lists of records by their display name or name."""
    df = spark.read.json(path, multiLine=not lines, mode="PERMISSIVE")
    return df.select(*(flattened(df, c).alias(c) for c in df.columns if c != "_corrupt_record"))


def flattened(df: DataFrame, name: str) -> Column:
    """A nested column as text: '; '-joined list, display name, or JSON."""
    from pyspark.sql import types as T

    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    label = lambda t: next((n for n in ("display_name", "name", "title") if n in t.fieldNames()), None)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            n = label(kind.elementType)
            return F.array_join(F.transform(c, lambda x: x[n] if n else F.to_json(x)), "; ")
        return F.array_join(F.transform(c, lambda x: x.cast("string")), "; ") if not isinstance(kind.elementType, T.ArrayType) else F.to_json(c)
    if isinstance(kind, T.StructType):
        n = label(kind)
        return c[n] if n else F.to_json(c)
    return c


def crossref(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """CrossRef messages: items with authors and issued date parts. A message is held whole, so files should hold a message (a page of the service, a thousand items at most) each, or with lines one on each line."""
    schema = "message struct<items: array<struct<DOI: string, title: array<string>, author: array<struct<given: string, family: string>>, issued: struct<`date-parts`: array<array<int>>>, `container-title`: array<string>, `is-referenced-by-count`: bigint, type: string>>>"
    x = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("message.items").alias("x"))
    return x.select(
        F.col("x.DOI").alias("doi"), F.col("x.title")[0].alias("title"), F.array_join(F.transform("x.author", lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ").alias("authors"),
        F.col("x.issued")["date-parts"][0][0].alias("year"), F.col("x.container-title")[0].alias("source"), F.col("x.is-referenced-by-count").alias("cited_by"), F.col("x.type").alias("document_type"),
    )


def orcid(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ORCID works: title, year, source, type and DOI of each work summary. One person's works are held whole: a file for each, or with lines one on each line."""
    schema = "group array<struct<`work-summary`: array<struct<title: struct<title: struct<value: string>>, `publication-date`: struct<year: struct<value: string>>, `journal-title`: struct<value: string>, type: string, `external-ids`: struct<`external-id`: array<struct<`external-id-type`: string, `external-id-value`: string>>>>>>>"
    x = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("group").alias("g")).select(F.col("g.work-summary")[0].alias("x"))
    ids = F.filter(F.col("x.external-ids.external-id"), lambda i: i["external-id-type"] == "doi")
    return x.select(F.col("x.title.title.value").alias("title"), F.col("x.publication-date.year.value").alias("year"), F.col("x.journal-title.value").alias("source"), F.col("x.type").alias("document_type"), F.try_element_at(ids, F.lit(1))["external-id-value"].alias("doi"))


def endnote_xml(spark: SparkSession, path: str) -> DataFrame:
    """EndNote XML records; styled text is unwrapped."""
    schema = "titles struct<title: string, `secondary-title`: string>, contributors struct<authors: struct<author: array<string>>>, dates struct<year: string>, keywords struct<keyword: array<string>>, abstract string, `electronic-resource-num` string"
    df = spark.read.schema(schema).xml(path, rowTag="record")
    bare = lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", ""))
    joined = lambda c: F.array_join(F.transform(c, lambda x: bare(x)), "; ")
    return df.select(bare(F.col("titles.title")).alias("title"), bare(F.col("titles.secondary-title")).alias("source"), joined("contributors.authors.author").alias("authors"), F.regexp_extract(F.col("dates.year"), r"(\d{4})", 1).alias("year"), joined("keywords.keyword").alias("author_keywords"), bare(F.col("abstract")).alias("abstract"), bare(F.col("electronic-resource-num")).alias("doi"))


def dblp_xml(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("article", "inproceedings", "incollection", "book", "phdthesis")) -> DataFrame:
    """DBLP XML: one scan for each kind of element."""
    schema = "author array<string>, title string, year string, journal string, booktitle string, ee array<string>"
    out = None
    for kind in kinds:
        df = spark.read.schema(schema).xml(path, rowTag=kind).select(F.array_join("author", "; ").alias("authors"), "title", "year", F.coalesce("journal", "booktitle").alias("source"), F.nullif(F.regexp_extract(F.array_join("ee", " "), r"doi\.org/(\S+)", 1), F.lit("")).alias("doi"), F.lit(kind).alias("document_type"))
        out = df if out is None else out.union(df)
    return out


def zotero_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Zotero RDF: articles with Dublin Core titles, dates and authors."""
    schema = "`dc:title` string, `dc:date` string, `dcterms:abstract` string, `bib:authors` struct<`rdf:Seq`: struct<`rdf:li`: array<struct<`foaf:Person`: struct<`foaf:surname`: string, `foaf:givenName`: string>>>>>"
    df = spark.read.schema(schema).xml(path, rowTag="bib:Article")
    people = F.transform(F.col("`bib:authors`.`rdf:Seq`.`rdf:li`"), lambda p: F.concat_ws(", ", p["foaf:Person"]["foaf:surname"], p["foaf:Person"]["foaf:givenName"]))
    return df.select(F.col("`dc:title`").alias("title"), F.regexp_extract(F.col("`dc:date`"), r"(\d{4})", 1).alias("year"), F.col("`dcterms:abstract`").alias("abstract"), F.array_join(people, "; ").alias("authors"))


def pubmed_summary(spark: SparkSession, path: str) -> DataFrame:
    """Numbered citations '1: Authors. Title. Journal. Year ...', a blank line between, with PMID and DOI where they stand in the text."""
    text = spark.read.text(path, lineSep="\n\n").select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("r")).where(F.col("r").rlike(r"^\d+[.:] "))
    part = lambda p, g=1: F.nullif(F.trim(F.regexp_extract("r", p, g)), F.lit(""))
    head = r"^\d+[.:] +(.+?)\. +(.+?[.?!]) +(.+?)\. +(\d{4})"
    return text.select(F.regexp_replace(part(head, 1), ", ", "; ").alias("authors"), F.regexp_replace(part(head, 2), r"\.$", "").alias("title"), part(head, 3).alias("source"), part(head, 4).alias("year"), part(r"PMID: *(\d+)").alias("pmid"), part(r"doi: *(10\.\S+?)\.?(?: |$)").alias("doi"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One identifier a line."""
    return spark.read.text(path).select(F.trim("value").alias("pmid")).where("pmid <> ''")


def excel(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet by way of pandas on the driver: such files hold a million rows at most. Needs an installed spreadsheet library."""
    return spark.createDataFrame(pd.read_excel(path, dtype=str))


#: (database, kind of file) -> reader.
READERS: dict[tuple[str, str], Callable] = {
    **{(db, "csv"): csv for db in ("scopus", "openalex", "dimensions", "lens", "pubmed", "cochrane", "ieee", "proquest", "semanticscholar", "eric", "embase", "generic")},
    **{(db, "ris"): ris for db in ("scopus", "cochrane", "ieee", "proquest", "ebsco", "jstor", "psycinfo", "eric", "econlit", "inspec", "georef", "cab", "cinahl", "embase", "generic")},
    **{(db, "bib"): bibtex for db in ("scopus", "wos", "ieee", "dblp", "arxiv", "mathscinet", "generic")},
    **{(db, "xlsx"): excel for db in ("openalex", "wos", "dimensions", "generic")},
    **{(db, "json"): json_records for db in ("lens", "semanticscholar", "openalex", "generic")},
    ("wos", "txt"): wos_text,
    ("pubmed", "txt"): medline,
    ("pubmed", "nbib"): medline,
    ("pubmed", "ids"): id_list,
    ("pubmed", "summary"): pubmed_summary,
    ("crossref", "json"): crossref,
    ("orcid", "json"): orcid,
    ("endnote", "xml"): endnote_xml,
    ("dblp", "xml"): dblp_xml,
    ("zotero", "rdf"): zotero_rdf,
}


def read(spark: SparkSession, path: str, db: str = "generic", kind: str | None = None, **options) -> DataFrame:
    """A file of a database, columns under their logical names. kind: the file's ending, if not given."""
    key = (re.sub(r"[\s_-]", "", db.lower()), (kind or path.rsplit(".", 1)[-1]).lower())
    if key not in READERS:
        raise ValueError(f"no reader for {key[0]} {key[1]}; there are: {', '.join(f'{a} {b}' for a, b in sorted(READERS))}")
    return standardise(READERS[key](spark, path, **options))
