"""Writers of graphs: element JSON for graph viewers, GraphViz text, XGMML rows, node JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import label


def node_json(nodes: DataFrame) -> DataFrame:
    """(node_id, json): attributes as lists of texts."""
    return nodes.select("node_id", F.to_json(F.transform_values("attrs", lambda _, v: F.transform(v, lambda x: x["s"]))).alias("json"))


def elements(result_nodes: DataFrame, result_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(json) rows of a graph viewer's elements: nodes n<id>, edges e<src>-<dst> with flow and methods."""
    named = result_nodes.join(nodes.select("node_id", "type", label(("displayname", "name")).alias("label")), "node_id", "left")
    n = named.select(F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct(F.concat(F.lit("n"), "node_id").alias("id"), "label", "type", "reference").alias("data"))).alias("json"))
    e = result_edges.select(F.to_json(F.struct(F.lit("edges").alias("group"), F.struct(F.concat(F.lit("e"), "src", F.lit("-"), "dst").alias("id"), F.concat(F.lit("n"), "src").alias("source"), F.concat(F.lit("n"), "dst").alias("target"), "flow", F.col("edge_types").alias("methods")).alias("data"))).alias("json"))
    return n.union(e)


def graphviz(result_nodes: DataFrame, result_edges: DataFrame) -> DataFrame:
    """(line) rows of the body of a digraph."""
    n = result_nodes.select(F.format_string('"%d";', "node_id").alias("line"))
    return n.union(result_edges.select(F.format_string('"%d" -> "%d" [label="%s"];', "src", "dst", F.array_join("edge_types", ", "))))


def xgmml_edges(result_edges: DataFrame) -> DataFrame:
    """Rows for write.format("xml") with rowTag edge."""
    return result_edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.array_join("edge_types", ", ").alias("_label"), "flow")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
