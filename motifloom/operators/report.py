"""Output levels 0 to 3, and motif files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["s", "e", "comp"]


def summary(members: DataFrame) -> DataFrame:
    """Level 0, one row: most edges of a motif, edges of all, longest and mean interval, motifs."""
    sizes = members.groupBy(*KEY).agg(F.count("*").alias("size"))
    length = F.col("e") - F.col("s") + 1
    return sizes.agg(
        F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("max_edges"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("all_edges"),
        F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_length"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_length"), F.count("*").cast("long").alias("motifs"),
    )


def by_interval(members: DataFrame) -> DataFrame:
    """Level 1: (s, e, motifs, sizes), the edges of each motif in the order of their smallest edge."""
    sizes = members.groupBy(*KEY).agg(F.count("*").alias("size"))
    listed = F.array_sort(F.collect_list(F.struct("comp", "size")))
    return sizes.groupBy("s", "e").agg(F.count("*").alias("motifs"), F.array_join(F.transform(listed, lambda x: x["size"].cast("string")), ",").alias("sizes"))


def edges_with_labels(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Level 2: one row per edge of a motif, with its ends and main label."""
    return members.join(edges, "edge_id").select(*KEY, "edge_id", "u", "v", "label")


def edge_ids(members: DataFrame) -> DataFrame:
    """Level 3: (s, e, size, ids), the edge ids of each motif joined by commas."""
    ids = F.array_sort(F.collect_list("edge_id"))
    return members.groupBy(*KEY).agg(F.count("*").alias("size"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids")).select("s", "e", "comp", "size", "ids")


def write_motifs(members: DataFrame, path: str) -> None:
    """Level 3 as text files that read_motifs understands: an interval's motifs together."""
    block = F.concat(F.lit("E"), F.col("size"), F.lit("\n"), F.col("ids"))
    rows = edge_ids(members).groupBy("s", "e").agg(F.array_sort(F.collect_list(F.struct("comp", block.alias("x")))).alias("m"))
    text = F.concat(F.lit("startT: "), F.col("s"), F.lit("\tendT: "), F.col("e"), F.lit("\n"), F.array_join(F.transform("m", lambda x: x["x"]), "\n"))
    rows.select(text.alias("value")).write.text(path)
