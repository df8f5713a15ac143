"""Scalar functions on bibliographic strings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_doi(c: Column) -> Column:
    """Small letters, one known prefix removed; null unless it begins with 10."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(x.startswith("10."), x)


def normal_title(c: Column) -> Column:
    """Small letters without punctuation, single spaces; null under 10 characters."""
    x = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", ""), r"\s+", " "))
    return F.when(F.length(x) >= 10, x)


def short_author(c: Column) -> Column:
    """'Last, First' as 'Last, F.'."""
    return F.regexp_replace(c, r"^([^,]+),\s*(\w).*$", "$1, $2.")


def author_parts(c: Column) -> Column:
    """(last, first, initials) of 'Last, First' or 'First Last'."""
    comma = c.contains(",")
    last = F.trim(F.when(comma, F.element_at(F.split(c, ","), 1)).otherwise(F.element_at(F.split(F.trim(c), r"\s+"), -1)))
    first = F.trim(F.when(comma, F.substring_index(c, ",", -1)).otherwise(F.regexp_replace(F.trim(c), r"\s*\S+$", "")))
    initials = F.array_join(F.transform(F.filter(F.split(first, r"[\s.\-]+"), lambda x: x != ""), lambda x: F.upper(F.substring(x, 1, 1))), "")
    return F.struct(last.alias("last"), first.alias("first"), initials.alias("initials"))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the sets of two-letter runs; 1 where both are equal."""
    grams = lambda x: F.array_distinct(F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array(x)))
    ga, gb = grams(a), grams(b)
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(ga, gb)) / F.size(F.array_union(ga, gb)))


DOI = r"10\.\d{4,9}/[^\s;,\"<>]+"


def reference_dois(c: Column) -> Column:
    """Distinct DOIs in a text in order, trailing punctuation removed, small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({DOI})"), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, r"[.\])]+$", ""))))


def reference_parts(c: Column) -> Column:
    """(year, doi, pmid, volume, pages, first_author, title) of a reference string; absent parts are null."""
    part = lambda p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    return F.struct(
        F.try_to_number(part(r"\b((?:1[5-9]|20)\d{2})\b"), F.lit("9999")).cast("int").alias("year"), F.lower(F.regexp_replace(part(f"({DOI})"), r"[.\])]+$", "")).alias("doi"), part(r"(?i)pmid:?\s*(\d+)").alias("pmid"),
        part(r"(?i)\bvol(?:ume)?\.?\s*(\d+)").alias("volume"), part(r"(?i)\bpp?\.?\s*(\d+\s*[-–]\s*\d+)").alias("pages"), part(r"^\s*([^,(]+,\s*[^,(.]+\.?)").alias("first_author"), part(r"\)\.?\s*([^.]+)\.").alias("title"),
    )


def ca_country(c: Column) -> Column:
    """The last comma part of a correspondence address without its mail part."""
    return F.trim(F.regexp_replace(F.element_at(F.split(F.regexp_replace(c, r";\s*(e-?mail:)?\s*\S+@\S+.*$", ""), ","), -1), r"[.;]+$", ""))


def mail_domain(c: Column) -> Column:
    """The last part of the first mail address's domain."""
    return F.nullif(F.regexp_extract(c, r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.([A-Za-z]{2,})", 1), F.lit(""))


def keywords(c: Column, synonyms: dict[str, str] | None = None, exclude: list[str] | None = None) -> Column:
    """A list of keywords in small letters, underscores and hyphens as spaces, punctuation removed, synonyms replaced, sorted and distinct."""
    def clean(x: Column) -> Column:
        x = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"[_\-‐‑–—]", " "), r"[^\w\s]", ""), r"\s+", " "))
        for old, new in (synonyms or {}).items():
            x = F.when(x == old, new).otherwise(x)
        return x

    items = F.array_distinct(F.transform(c, clean))
    return F.array_sort(F.filter(items, lambda x: (x != "") & ~x.isin(exclude or [""])))


def clean_text(c: Column, stopwords: list[str], shortest: int = 3) -> Column:
    """Small letters, punctuation as spaces, stop words and short words removed."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " ")), r"\s+")
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    return F.array_join(F.filter(words, lambda w: (F.length(w) >= shortest) & ~F.array_contains(stop, w)), " ")


def repository_links(c: Column) -> Column:
    """Distinct links to code and data repositories."""
    hosts = r"(?:github\.com|gitlab\.com|bitbucket\.org|zenodo\.org|figshare\.com|datadryad\.org|osf\.io|dataverse\.[a-z.]+|huggingface\.co|kaggle\.com)"
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"((?:https?://)?(?:www\.)?{hosts}/[^\s)\]>\"']+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;]+$", "")))


def sample_sizes(c: Column) -> Column:
    """Distinct integers from 1 to 1,000,000 that follow 'n =' or precede participants and the like, sorted."""
    found = F.concat(F.regexp_extract_all(c, F.lit(r"(?i)\bn\s*=\s*(\d[\d,]*)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"(?i)\b(\d[\d,]*)\s+(?:participants|patients|respondents|subjects|students|samples|interviews)"), F.lit(1)))
    numbers = F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("long"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, 1_000_000))))
