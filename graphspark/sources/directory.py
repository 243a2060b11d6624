"""The star schema as a directory: domains, units, accounts, machines and groups with the attributes that edge rules read,
and access lists whose entries are orders. All of it grows with the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import attributes
from .tables import STEP, table

#: Groups of a domain, by the market segment of their members.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
GROUP, MACHINE, POLICY, CROSS, SERVICE, TEMPLATE = 9 * STEP, 10 * STEP, 11 * STEP, 12 * STEP, 13 * STEP, 14 * STEP
BUILT_IN, SYNC, RUNNER = 16 * STEP, 17 * STEP, 18 * STEP
#: Policies of a domain, plain and enforced, stand behind those of its units.
PLAIN, ENFORCED = POLICY + 1000, POLICY + 2000
#: Groups and ids that each domain has, in the order of their nodes.
BUILT_IN_SIDS = ("S-1-5-32-544", "S-1-5-32-555", "S-1-5-32-562", "S-1-5-9", "S-1-5-11", "S-1-1-0", "S-1-5-32-549", "S-1-5-32-551")
#: Account flags: fixed values of the format.
NORMAL, DISABLED, WORKSTATION, SERVER, NEVER_EXPIRES, DELEGATION, NO_PREAUTH, AUTH_DELEGATION = 0x200, 0x2, 0x1000, 0x2000, 0x10000, 0x80000, 0x400000, 0x1000000


#: Rows whose attributes one task makes, about.
ROWS_A_TASK = 100_000


def domain_dn(name: Column) -> Column:
    return F.concat(F.lit("DC="), name, F.lit(",DC=example"))


def domain_sid(region: Column) -> Column:
    return F.concat(F.lit("S-1-5-21-"), (region + 100).cast("string"), F.lit("-1-1"))


def user_sid(region: Column, key: Column) -> Column:
    return F.concat(domain_sid(region), F.lit("-"), (key + 1000).cast("string"))


def flag(when: Column, bit: int) -> Column:
    return F.when(when, F.lit(bit)).otherwise(F.lit(0))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key to as many tasks as two a core, and more where there are many: attributes and entries are some
    0.1 ms a row, and the files of a table may be few, or of one row group."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)), key)


def _places(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_regionkey", "r_name")


def _node(df: DataFrame, node_id: Column, kind: str | Column, **attrs: tuple[str, Column]) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(node_id.cast("bigint").alias("node_id"), kind.alias("type"), attributes(**attrs).alias("attrs"), F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<string>").alias("tags"))


def directory(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of the directory."""
    places = _places(spark, d)
    region = table(spark, d, "region")
    text = lambda c: ("string", c)
    domain = domain_dn(F.col("r_name"))
    unit = F.concat(F.lit("OU="), "n_name", F.lit(","), domain)
    policy_dn = F.concat(F.lit("CN=P"), "n_nationkey", F.lit(",CN=Policies,"), domain)
    link = F.concat(F.lit("[LDAP://"), policy_dn, F.lit(";"), F.when(F.col("n_nationkey") % 3 == 0, "1").otherwise("0"), F.lit("]"))
    blocked = F.when(F.col("n_nationkey") % 4 == 1, F.lit("1"))  # such units keep out what is not enforced
    wide_dn = lambda kind: F.concat(F.lit(f"CN={kind}"), "r_regionkey", F.lit(",CN=Policies,"), domain)
    wide_link = F.concat(F.lit("[LDAP://"), wide_dn("PLAIN"), F.lit(";0][LDAP://"), wide_dn("FORCED"), F.lit(";2]"))
    people = _spread(table(spark, d, "customer"), "c_custkey").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    hosts = _spread(table(spark, d, "supplier"), "s_suppkey").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    user_flags = flag(k % 2 == 0, DISABLED) + flag(k % 3 == 0, NEVER_EXPIRES) + flag(k % 5 == 0, NO_PREAUTH)
    host_flags = flag(s % 10 == 0, SERVER) + flag(s % 10 != 0, WORKSTATION) + flag(s % 7 == 0, DELEGATION)
    host_name = F.concat(F.lit("s"), "s_suppkey", F.lit("."), F.lower("r_name"), F.lit(".example"))
    host_sid = F.concat(domain_sid(F.col("r_regionkey")), F.lit("-"), (s + 500_000_000).cast("string"))
    group_dn = lambda segment: F.concat(F.lit("CN="), segment, F.lit(",CN=Groups,"), domain)
    segments = region.select("r_regionkey", "r_name", F.posexplode(F.array(*[F.lit(x) for x in SEGMENTS])).alias("g", "segment"))
    group_id = F.lit(GROUP) + F.col("r_regionkey") * 100 + F.col("g")
    # the second group of a domain is in its first, and so on
    up = F.when(F.col("g") > 0, group_dn(F.element_at(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("g"))))
    group_rid = F.element_at(F.array(F.lit(512), F.lit(525), F.lit(1103), F.lit(551), F.lit(1105)), F.col("g") + 1)
    parts = [
        _node(region, F.lit(STEP) + F.col("r_regionkey"), "DomainDNS", distinguishedname=text(domain), objectsid=text(domain_sid(F.col("r_regionkey"))), objectclass=text(F.lit("domainDNS")), domaincontext=text(domain), gplink=text(wide_link)),
        _node(region, F.lit(PLAIN) + F.col("r_regionkey"), "GroupPolicyContainer", distinguishedname=text(wide_dn("PLAIN"))),
        _node(region, F.lit(ENFORCED) + F.col("r_regionkey"), "GroupPolicyContainer", distinguishedname=text(wide_dn("FORCED"))),
        _node(region, F.lit(CROSS) + F.col("r_regionkey"), "CrossRef", objectclass=text(F.lit("crossRef")), ncname=text(domain), netbiosname=text(F.col("r_name")), dnsroot=text(F.concat(F.lower("r_name"), F.lit(".example"))), distinguishedname=text(F.concat(F.lit("CN="), "r_name", F.lit(",CN=Partitions,DC=example")))),
        _node(region, F.lit(SERVICE) + F.col("r_regionkey"), "Container", distinguishedname=text(F.concat(F.lit("CN=AdminSDHolder,CN=System,"), domain)), domaincontext=text(domain)),
        _node(places, F.lit(2 * STEP) + F.col("n_nationkey"), "OrganizationalUnit", distinguishedname=text(unit), gplink=text(link), gpoptions=text(blocked)),
        _node(places, F.lit(POLICY) + F.col("n_nationkey"), "GroupPolicyContainer", distinguishedname=text(policy_dn)),
        _node(segments, group_id, "Group", distinguishedname=text(group_dn(F.col("segment"))), objectsid=text(F.concat(domain_sid(F.col("r_regionkey")), F.lit("-"), group_rid)), memberof=text(up), samaccountname=text(F.col("segment")), domaincontext=text(domain)),
        _node(
            people, F.lit(3 * STEP) + k, "User", distinguishedname=text(F.concat(F.lit("CN=U"), k, F.lit(","), unit)), objectsid=text(user_sid(F.col("r_regionkey"), k)),
            useraccountcontrol=("int", user_flags), serviceprincipalname=text(F.when(k % 4 == 0, F.concat(F.lit("http/u"), k))), memberof=text(group_dn(F.col("c_mktsegment"))),
            samaccountname=text(F.concat(F.lit("U"), k)), name=text(F.col("c_name")), samaccounttype=("int", F.lit(805306368)),
        ),
        _node(
            hosts, F.lit(4 * STEP) + s, "Computer", distinguishedname=text(F.concat(F.lit("CN=S"), s, F.lit(","), unit)), objectsid=text(host_sid), dnshostname=text(host_name),
            useraccountcontrol=("int", host_flags), operatingsystem=text(F.when(s % 3 == 0, F.lit("Linux 6")).otherwise(F.lit("Windows Server"))),
            name=text(F.concat(F.lit("S"), s)), samaccountname=text(F.concat(F.lit("S"), s, F.lit("$"))),
            **{"ms-mcs-admpwdexpirationtime": text(F.when(s % 2 == 0, F.lit("1")))}, wuserver=text(F.concat(F.lit("http://s"), F.floor(s / 10) * 10, F.lit("."), F.lower("r_name"), F.lit(".example:8530"))),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def built_in(spark: SparkSession, d: str) -> DataFrame:
    """The groups and ids that each domain has, and the service point of replication."""
    region = table(spark, d, "region")
    text = lambda c: ("string", c)
    each = region.select("r_regionkey", "r_name", F.posexplode(F.array(*[F.lit(x) for x in BUILT_IN_SIDS])).alias("i", "sid"))
    number = F.lit(BUILT_IN) + F.col("r_regionkey") * 100 + F.col("i")
    groups = _node(each, number, "Group", objectsid=text(F.col("sid")), domaincontext=text(domain_dn(F.col("r_name"))), name=text(F.col("sid")), member=text(F.when(F.col("i") == 0, F.concat(F.lit(f"CN={SEGMENTS[0]},CN=Groups,"), domain_dn(F.col("r_name"))))))
    point = _node(region.limit(1), F.lit(SYNC), "CallableService", name=text(F.lit("DCsync")))
    return groups.unionByName(point.withColumn("tags", F.array(F.lit("hvt"))))


def service_accounts(spark: SparkSession, d: str) -> DataFrame:
    """An enabled account with a service name for each nation, in a group of its domain."""
    text = lambda c: ("string", c)
    n, domain = F.col("n_nationkey"), domain_dn(F.col("r_name"))
    group = F.concat(F.lit("CN="), F.element_at(F.array(*[F.lit(x) for x in SEGMENTS]), (n % len(SEGMENTS) + 1).cast("int")), F.lit(",CN=Groups,"), domain)
    return _node(
        _places(spark, d), F.lit(RUNNER) + n, "User", distinguishedname=text(F.concat(F.lit("CN=R"), n, F.lit(",OU="), "n_name", F.lit(","), domain)),
        objectsid=text(_service_sid()), useraccountcontrol=("int", F.lit(NORMAL)), serviceprincipalname=text(F.concat(F.lit("http/r"), n)), memberof=text(group),
        samaccountname=text(F.concat(F.lit("R"), n)), samaccounttype=("int", F.lit(805306368)),
    )


def _service_sid() -> Column:
    return F.concat(domain_sid(F.col("r_regionkey")), F.lit("-"), (F.col("n_nationkey") + 400_000_000).cast("string"))


def host_lists(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, type, descriptor, class_guids): the machine accounts, each of which its nation's service account may control."""
    entry = F.struct(
        F.lit(0).alias("ord"), F.lit(0).alias("type"), F.lit(0).alias("aceflags"), F.lit(0).alias("flags"), F.lit(ENTRY_MASKS[0]).cast("bigint").alias("mask"),
        _service_sid().alias("sid"), F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("string").alias("inherited_object_type"),
    )
    descriptor = F.struct(F.lit(0x8004).alias("control"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("grp"), F.array(entry).alias("dacl")).alias("descriptor")
    hosts = table(spark, d, "supplier").join(F.broadcast(_places(spark, d)), F.col("s_nationkey") == F.col("n_nationkey"))
    return hosts.select((F.lit(4 * STEP) + F.col("s_suppkey")).alias("node_id"), F.lit("Computer").alias("type"), descriptor, F.array().cast("array<string>").alias("class_guids"))


def service_principals(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, sid) of the trustees of host_lists()."""
    return _places(spark, d).select((F.lit(RUNNER) + F.col("n_nationkey")).alias("node_id"), _service_sid().alias("sid"))


#: Access masks of the orders' entries, by key modulo their number.
ENTRY_MASKS = (0x000F01FF, 0x00040000, 0x00000100, 0x00000020, 0x00000120, 0x00000008, 0x00000010, 0x00001000, 0x00080000)
PASSWORD, IDENTITIES, SET = "00299570-246d-11d0-a768-00aa006e0529", "00fbf30c-91fe-11d1-aebc-0000f80367c1", "e48d0154-bcf8-11d1-8702-00c04fb96050"
#: Rights and attributes that entries are about, by key.
ENTRY_ABOUT = (
    PASSWORD, "f3a64788-5306-11d1-a9c5-0000f80367c1", "3f78c3e5-f79a-46bd-a0b8-9d18116ddc79", "bf9679c0-0de6-11d0-a285-00aa003049e2", "bc0ac240-79a9-11d0-9020-00c04fc2d4cf",
    "5b47d60f-6090-40b2-9f37-2a4de88f3063", "bf967a68-0de6-11d0-a285-00aa003049e2", "bf967a05-0de6-11d0-a285-00aa003049e2", "bf9679a8-0de6-11d0-a285-00aa003049e2",
    "bf967924-0de6-11d0-a285-00aa003049e2", "0e78295a-c6d3-0a40-b491-d62251ffa0a6", "0e10c968-78fb-11d2-90d4-00c04f79dc55", "a05b8cc2-17bc-4802-a710-e7c15ab866a2",
    "1131f6aa-9c07-11d1-f79f-00c04fc2dcd2", "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2", "89e95b76-444d-4c62-991a-0facbeda640c", "1131f6ab-9c07-11d1-f79f-00c04fc2dcd2",
)
#: Types of the objects of access_lists() by the last digit of their key; others are users.
LIST_TYPES = ("DomainDNS", "Group", "Computer", "CertificateTemplate", "GroupManagedServiceAccount", "AttributeSchema")


def access_lists(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, type, descriptor, class_guids): an object for each customer with orders, an entry for each order, in the
    order of keys.

    A pending order denies; the trustee is one of the three customers before the orderer's key; every eleventh entry is
    inherit-only; of three entries one has no object type, one that of a right or attribute and one that of an attribute
    set."""
    o, k = F.col("o_orderkey"), F.col("o_orderkey") % 3
    trustee = F.col("o_custkey") - 1 - k
    masks = F.array(*[F.lit(m).cast("bigint") for m in ENTRY_MASKS])
    about = F.element_at(F.array(*[F.lit(x) for x in ENTRY_ABOUT]), (F.floor(o / 3) % len(ENTRY_ABOUT) + 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "P", F.lit(1)).otherwise(F.lit(0)) + F.when(k > 0, F.lit(5)).otherwise(F.lit(0))
    entry = F.struct(
        o.cast("int").alias("ord"), kind.cast("int").alias("type"), F.when(o % 11 == 0, 8).otherwise(0).cast("int").alias("aceflags"), F.lit(0).alias("flags"),
        F.element_at(masks, (o % len(ENTRY_MASKS) + 1).cast("int")).alias("mask"), F.concat(F.lit("S-1-5-21-1-1-1-"), trustee).alias("sid"),
        F.when(k == 1, about).when(k == 2, F.lit(SET)).alias("object_type"), F.lit(None).cast("string").alias("inherited_object_type"),
    )
    orders = _spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey")
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("dacl"))
    owner = F.concat(F.lit("S-1-5-21-1-1-1-"), F.floor(F.col("o_custkey") / 2))
    descriptor = F.struct(F.lit(0x8004).alias("control"), owner.alias("owner"), F.lit(None).cast("string").alias("grp"), "dacl").alias("descriptor")
    digit = F.col("o_custkey") % 10
    kind_of = F.when(digit < len(LIST_TYPES), F.get(F.array(*[F.lit(t) for t in LIST_TYPES]), digit.cast("int"))).otherwise("User").alias("type")
    return lists.select((F.lit(3 * STEP) + F.col("o_custkey")).alias("node_id"), kind_of, descriptor, F.array(F.lit("bf967aba-0de6-11d0-a285-00aa003049e2")).alias("class_guids"))


def attribute_sets(spark: SparkSession, d: str) -> DataFrame:
    """(guid, set_guid) of attributes that entries are about; one of them belongs to the set."""
    rows = table(spark, d, "region").select(F.explode(F.array(F.lit(IDENTITIES), F.lit(PASSWORD))).alias("guid")).distinct()
    return rows.select("guid", F.when(F.col("guid") == IDENTITIES, F.lit(SET)).alias("set_guid"))


def principals(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, sid) of the trustees of access_lists()."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select((F.lit(3 * STEP) + k).alias("node_id"), F.concat(F.lit("S-1-5-21-1-1-1-"), k).alias("sid"))
