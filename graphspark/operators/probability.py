"""Probabilities of edges that depend on the pair: its other edges, and the type, tags and password age of the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import values_of

# What an edge of a type leads on with, if nothing else is known; others 100.
FIXED = {
    "ACLContainsDeny": 0, "AllExtendedRights": 0, "DSReplGetChngs": 0, "DSReplGetChngsAll": 0, "DSReplGetChngsInFiltSet": 0, "DSReplSync": 0,
    "MachineAccount": -1, "ReadPasswordId": 5, "SIDCollision": 0, "SeImpersonate": 20, "SeNetworkLogonRight": 10, "WriteAll": 0, "WriteAttrSecurityGUID": 0,
    "WriteExtendedAll": 0, "WritePropertyAll": 0, "WriteUserAccountControl": 50,
}
#: A disabled user is of no use, unless the pair can enable it: 0 there.
ENABLED_USER = {
    "DCOMRights": 30, "RDPRights": 30, "ResetPassword": 100, "SMSAdmins": 50, "Session": 80, "SessionBatch": 30, "SessionLocal": 55, "SessionNetwork": 30,
    "SessionNetworkKerberos": 20, "SessionNetworkNTLM": 30, "SessionNetworkNTLMV2": 20, "SessionNetworkNegotiate": 20, "SessionNetworkPlaintext": 80,
    "SessionRDP": 30, "SessionService": 30, "WriteAltSecIdent": 100,
}
ENABLED = ("WriteKeyCredentialLink",)
GUESSED = ("DontReqPreauth", "HasSPN", "WriteSPN", "WriteValidatedSPN")  # a password has to be guessed: the older the easier
HOURS_OF_TEN_YEARS = 24 * 365 * 10
ENABLES = "WriteUserAccountControl"


def _guess(active: Column, age: Column) -> Column:
    """20 to 80 by the age of the password in hours, 50 where it is unknown, 0 of inactive accounts."""
    risk = F.greatest(F.lit(20), F.least(F.lit(80), F.floor(age * 80 / HOURS_OF_TEN_YEARS)))
    return F.when(active, F.when(age.isNotNull(), risk).otherwise(50)).otherwise(0)


def rated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with prob by the rules above. nodes: node_id, type, tags, attrs (passwordage in hours). A pair's other edges
    count by one aggregation of the pairs that can enable an account; the target's by one join."""
    has = lambda tag: F.array_contains("tags", tag)
    target = nodes.select(F.col("node_id").alias("dst"), F.col("type").alias("kind"), has("account_enabled").alias("on"), has("account_active").alias("active"), values_of("passwordage")[0]["i"].alias("age"))
    enabling = edges.where(F.col("edge_type") == ENABLES).select("src", "dst").distinct().withColumn("enables", F.lit(True))
    joined = edges.drop("prob").join(target, "dst", "left").join(enabling, ["src", "dst"], "left")
    on, enables = F.coalesce("on", F.lit(False)), F.coalesce("enables", F.lit(False))
    not_user = F.coalesce(F.col("kind") != "User", F.lit(True))
    t = F.col("edge_type")
    number = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t)
    fixed = F.coalesce(number(FIXED), F.lit(100))
    prob = (
        F.when(t.isin(*ENABLED_USER), F.when(not_user | on | enables, number(ENABLED_USER)).otherwise(0))
        .when(t.isin(*ENABLED), F.when(on | enables, 100).otherwise(0))
        .when(t.isin(*GUESSED), _guess(F.coalesce("active", F.lit(False)), F.col("age")))
        .otherwise(fixed)
    )
    return joined.select(*[c for c in edges.columns if c != "prob"], prob.cast("int").alias("prob"))
