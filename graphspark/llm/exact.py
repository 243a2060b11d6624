"""Exact deduplication, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", content_hash: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows form a group when their 128-bit content hash is equal and so are their bytes: the grouping key holds the hash
    and the text itself, so that two texts with one hash are two groups. Copies meet before the shuffle (partial
    aggregation), so a text that a third of all rows repeats is sent once per task. Each row then finds its group by
    (hash, SHA-256), and only groups of several rows take part in that join; a hot group is split by adaptive
    execution.

    keep: "max" or "min", the id that stays. content_hash: a Column over text_col, by default its MD5.

    Null text counts as empty and empty texts are equal. A repeated id is a row of its own; ties cannot occur between
    distinct ids. An empty table gives an empty result; other columns are ignored.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__t"))
    h = F.unhex(F.md5(F.col("__t").cast("binary"))) if content_hash is None else content_hash
    if content_hash is not None:
        rows = docs.select(F.col(id_col).alias("__id"), text.alias("__t"), h.alias("__h"))
    else:
        rows = rows.withColumn("__h", h)
    groups = (
        rows.groupBy("__h", "__t").agg(pick("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select("__h", F.unhex(F.sha2(F.col("__t").cast("binary"), 256)).alias("__s"), "__keep", "__n")
    )
    narrow = rows.select("__id", "__h", F.unhex(F.sha2(F.col("__t").cast("binary"), 256)).alias("__s"))
    return narrow.join(groups, ["__h", "__s"], "left").select(
        F.col("__id").alias(id_col),
        F.coalesce("__keep", "__id").alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__keep") == F.col("__id"), F.lit(True)).alias("kept"),
        F.lower(F.hex("__s")).alias("text_sha256"),
    )
