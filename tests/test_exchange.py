"""Exports that queries write: no row holds the records of a whole group."""

import pytest

from folioscope.plans import exchange, registry


@pytest.mark.parametrize(("name", "mark"), [("read_crossref", '"DOI"'), ("read_orcid", '"work-summary"'), ("read_endnote_xml", "<record>"), ("read_dblp_xml", "<title>"), ("read_zotero_rdf", "<bib:Article>")])
def test_small_rows(spark, sf, tmp_path, monkeypatch, name, mark):
    monkeypatch.setattr(exchange, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(exchange, "_PAGE", 50, raising=False)
    n = registry.QUERIES[name](spark, sf).count()
    lines = [x.count(mark) for f in tmp_path.rglob("part-*") for x in f.read_text().splitlines()]
    assert sum(lines) == n > 1000 and max(lines) <= 50
