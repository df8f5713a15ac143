"""The logical columns of a publication table and the names under which databases keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The vendors' column names.

#: Logical name -> names seen in exports, in any case; first hit wins.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "doi": ("DOI", "DI", "ids.doi"),
    "title": ("Title", "display_name", "TI", "Document Title", "Article Title", "ArticleTitle"),
    "abstract": ("Abstract", "AB", "abstract_text"),
    "year": ("Year", "publication_year", "Publication Year", "PY", "PubYear", "Year Published", "Pub Year"),
    "authors": ("Authors", "Author", "AU", "Author full names", "Author Names", "Author/s", "authorships.author.display_name"),
    "author_ids": ("Author(s) ID", "authorships.author.id", "author_ids"),
    "source": ("Source title", "source", "Journal", "SO", "Publication Title", "primary_location.source.display_name", "Journal/Book", "Journal Title"),
    "author_keywords": ("Author Keywords", "keywords", "DE", "KW", "keywords.display_name"),
    "index_keywords": ("Index Keywords", "ID", "MeSH terms", "mesh"),
    "cited_by": ("Cited by", "cited_by_count", "cited_by", "TC", "Times Cited", "Citing Works Count", "Scholarly Citations", "Times Cited, All Databases", "Citing Patents and Works Count"),
    "references": ("References", "referenced_works", "CR", "Cited References"),
    "affiliations": ("Affiliations", "C1", "Authors with affiliations", "Authors Affiliations"),
    "correspondence": ("Correspondence Address", "RP", "Reprint Addresses"),
    "document_type": ("Document Type", "type", "DT", "Publication Type"),
    "language": ("Language", "LA", "Language of Original Document"),
    "open_access": ("Open Access", "open_access.is_oa", "OA"),
    "countries": ("Countries of Authors", "Countries", "Country of Research organization"),
}

#: Columns that tell a database, and how many of them must be there; the first match wins.
SIGNATURES: dict[str, tuple[int, tuple[str, ...]]] = {
    "scopus": (3, ("EID", "Cited by", "Source title", "Author Keywords", "Author(s) ID", "Index Keywords")),
    "openalex": (3, ("id", "doi", "display_name", "publication_year", "cited_by_count", "referenced_works", "authorships.author.id")),
    "pubmed": (2, ("PMID", "MeSH Terms", "Journal", "ArticleTitle", "PMCID", "NIHMS ID")),
    "lens": (2, ("Lens ID", "Scholarly Citations", "Fields of Study", "Citing Works Count", "Citing Patents Count")),
    "dimensions": (2, ("Publication ID", "Times cited", "FOR (ANZSRC 2020)", "Fields of Research (ANZSRC 2020)", "Dimensions URL")),
    "wos": (2, ("UT", "WC", "SC", "TC", "CR", "UT (Unique WOS ID)")),
}


def _in_case(columns: list[str]) -> dict[str, str]:
    """Names as they are, and longer ones (tags of two letters have a case) in small letters too, for the column that has them."""
    return {c.casefold(): c for c in reversed(columns) if len(c) > 2} | {c: c for c in columns}


def first_existing(df: DataFrame, names) -> str | None:
    """The first of the names that is a column, in any case; the name as the table has it."""
    have = _in_case(df.columns)
    return next((have.get(n) or have[n.casefold()] for n in names if n in have or (len(n) > 2 and n.casefold() in have)), None)


def column(df: DataFrame, logical: str, required: bool = True) -> str | None:
    """The column under which a logical name is found."""
    found = first_existing(df, (logical, *CANDIDATES.get(logical, ())))
    if found is None and required:
        raise KeyError(f"no column for {logical!r}; looked for {', '.join(CANDIDATES.get(logical, (logical,)))}")
    return found


def standardise(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed to logical names, where found; mapping: more names, old to new."""
    names = {found: logical for logical in CANDIDATES if (found := column(df, logical, False)) and found != logical and logical not in df.columns}
    return df.withColumnsRenamed(names | (mapping or {}))


def detect_database(df: DataFrame) -> str:
    """The database whose signature columns are there, in any case, or 'unknown'."""
    have = _in_case(df.columns)
    met = lambda names: sum(n in have or (len(n) > 2 and n.casefold() in have) for n in names)
    return next((name for name, (least, names) in SIGNATURES.items() if met(names) >= least), "unknown")


def require(df: DataFrame, names: list[str]) -> None:
    """Raises KeyError with the names that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
