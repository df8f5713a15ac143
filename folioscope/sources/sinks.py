"""Exports: tables through the engine's writers, graphs as files of edges and nodes in the formats of graph programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.longform import running


def table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition: list[str] | None = None) -> None:
    """parquet, orc, json or csv (lists joined by '; ', quotes doubled, as the reader takes them)."""
    if kind == "csv":
        df = df.select(*((F.array_join(F.col(f"`{c}`"), "; ") if t.startswith("array<") else F.col(f"`{c}`").cast("string")).alias(c) for c, t in df.dtypes))
    writer = df.write.mode(mode).partitionBy(*(partition or []))
    writer.csv(path, header=True, escape='"') if kind == "csv" else writer.format(kind).save(path)


def joined_lists(df: DataFrame, sep: str = "; ") -> DataFrame:
    """Lists as delimited strings."""
    return df.select(*((F.array_join(F.col(f"`{c}`"), sep) if t.startswith("array<") else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes))


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graph_lines(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(part, line) of a file: nodes (node, label), edges (a, b, n). kind: graphml, gexf, pajek or vosviewer (map lines, then network lines)."""
    n = nodes.select(F.col("node").cast("string").alias("node"), F.col("label").cast("string").alias("label"))
    e = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("n").cast("string").alias("n"))
    if kind in ("pajek", "vosviewer"):
        # numbers from 1 in order of the nodes
        n = running(n, [F.col("node")], {"i": F.lit(1).cast("long")})
        num = lambda c, name: n.select(F.col("node").alias(c), F.col("i").cast("string").alias(name))
        e = e.join(num("a", "i"), "a").join(num("b", "j"), "b")
        q = F.lit('"')
        if kind == "pajek":
            head = n.agg(F.concat(F.lit("*Vertices "), F.count("*").cast("string")).alias("line")).select(F.lit(0).alias("part"), "line")
            body = n.select(F.lit(1).alias("part"), F.concat_ws(" ", F.col("i").cast("string"), F.concat(q, F.replace("label", q, F.lit("'")), q)).alias("line"))
            mark = n.limit(1).select(F.lit(2).alias("part"), F.lit("*Edges").alias("line"))
            return head.union(body).union(mark).union(e.select(F.lit(3).alias("part"), F.concat_ws(" ", "i", "j", "n").alias("line")))
        body = n.select(F.lit(0).alias("part"), F.concat_ws("\t", F.col("i").cast("string"), "label").alias("line"))
        return body.union(e.select(F.lit(1).alias("part"), F.concat_ws("\t", "i", "j", "n").alias("line")))
    if kind == "graphml":
        opening = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="l" for="node" attr.name="label" attr.type="string"/><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
        node, edge, closing = '<node id="%s"><data key="l">%s</data></node>', '<edge source="%s" target="%s"><data key="w">%s</data></edge>', "</graph></graphml>"
    elif kind == "gexf":
        opening = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>'
        node, edge, closing = '<node id="%s" label="%s"/>', '<edge source="%s" target="%s" weight="%s"/>', "</edges></graph></gexf>"
    else:
        raise ValueError(f"unknown kind {kind!r}")
    spark = nodes.sparkSession
    fixed = [(0, opening), (4, closing)] + ([(2, "</nodes><edges>")] if kind == "gexf" else [])
    lines = spark.createDataFrame(fixed, "part int, line string")
    lines = lines.union(n.select(F.lit(1).alias("part"), F.format_string(node, _xml(F.col("node")), _xml(F.col("label"))).alias("line")))
    return lines.union(e.select(F.lit(3).alias("part"), F.format_string(edge, _xml(F.col("a")), _xml(F.col("b")), "n").alias("line")))


def graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "graphml") -> None:
    """Writes one ordered file (for VOSviewer a folder for map and one for network)."""
    lines = graph_lines(nodes, edges, kind)
    if kind == "vosviewer":
        for part, name in ((0, "map"), (1, "network")):
            lines.where(F.col("part") == part).select("line").orderBy("line").coalesce(1).write.text(f"{path}/{name}")
    else:
        lines.repartition(1).sortWithinPartitions("part", "line").select("line").write.text(path)
