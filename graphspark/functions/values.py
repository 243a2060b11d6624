"""Attribute values: a struct that keeps the kind, the text form and the typed value; attributes are arrays of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<k:string,s:string,i:bigint,f:double,t:timestamp,b:boolean>"
ATTRS = f"map<string,array<{VALUE}>>"


def value(kind: str, c: Column) -> Column:
    """One value of kind string, int, float, time or bool."""
    null = lambda t: F.lit(None).cast(t)
    text = {"time": F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "bool": c.cast("string")}.get(kind, c.cast("string"))
    return F.struct(
        F.lit(kind).alias("k"), text.alias("s"),
        (c.cast("bigint") if kind == "int" else null("bigint")).alias("i"), (c.cast("double") if kind == "float" else null("double")).alias("f"),
        (c.cast("timestamp") if kind == "time" else null("timestamp")).alias("t"), (c.cast("boolean") if kind == "bool" else null("boolean")).alias("b"),
    )


def attributes(**columns: tuple[str, Column]) -> Column:
    """A map of lower-cased names to arrays of values; blank (null) ones are left out. (kind, array) for several values."""

    def entry(name: str, kind: str, c: Column) -> Column:
        values = F.transform(c, lambda x: value(kind[:-2], x)) if kind.endswith("[]") else F.array(value(kind, c))
        return F.struct(F.lit(name.lower()).alias("key"), F.when(c.isNotNull(), values).alias("value"))

    parts = [entry(name, kind, c) for name, (kind, c) in columns.items()]
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))


def sorted_union(values: Column) -> Column:
    """Attribute union on merge: distinct by lower-cased text, ordered by it; of equal ones the smallest spelling stays."""
    texts = F.array_sort(F.array_distinct(F.transform(values, lambda v: F.lower(v["s"]))))
    return F.transform(texts, lambda low: F.array_min(F.filter(values, lambda v: F.lower(v["s"]) == low)))


def with_attribute(nodes: DataFrame, name: str, text: Column) -> DataFrame:
    """nodes with a text attribute set where the Column is not null; what it was before goes there."""
    rest = F.map_filter("attrs", lambda k, _: k != name)
    return nodes.withColumn("attrs", F.when(text.isNotNull(), F.map_concat(rest, attributes(**{name: ("string", text)}))).otherwise(F.col("attrs")))
