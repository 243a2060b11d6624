"""Readers of collected dumps (JSON forms), as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.values import ATTRS, VALUE, attributes, value
from ..store import cut

OBJECTS = "DistinguishedName string, Attributes map<string,array<string>>"
OPEN_GRAPH = """metadata map<string,string>, graph struct<nodes:array<struct<id:string,kinds:array<string>,properties:map<string,string>>>,
    edges:array<struct<start:struct<match_by:string,value:string,kind:string>,end:struct<match_by:string,value:string,kind:string>,kind:string>>>"""
MACHINE = """Machine struct<Name:string,LocalSID:string,Domain:string,ComputerDomainSID:string,ProductName:string,WUServer:string,SCCMLastValidMP:string,IsDomainJoined:boolean>,
    Users array<struct<Name:string,SID:string,FullName:string>>,
    Groups array<struct<Name:string,SID:string,Comment:string,Members:array<struct<Name:string,SID:string>>>>,
    LoginInfos array<struct<User:string,Domain:string,SID:string,Count:bigint,LogonType:int,AuthenticationPackageName:string,IpAddress:array<string>>>,
    Privileges array<struct<Name:string,AssignedSIDs:array<string>>>"""
POLICY = """DomainDN string, Path string, GUID string,
    Files array<struct<RelativePath:string,OwnerSID:string,DACL:string,Contents:string,Size:bigint,IsDir:boolean>>"""

#: Classes of attributes by how their values are written: fixed values of the format. Others are told by their look.
CLASSES = {
    "filetime": (
        "accountexpires", "badpasswordtime", "creationtime", "lastlogon", "lastlogontimestamp", "ms-mcs-admpwdexpirationtime", "ms-laps-passwordexpirationtime", "pwdlastset",
    ),
    "generalized": (
        "dscorepropagationdata", "gwartlastmodified", "msexchlastupdatetime", "msexchpolicylastappliedtime", "msexchwhenmailboxcreated", "spacelastcomputed", "whenchanged", "whencreated",
    ),
    "period": ("pkiexpirationperiod", "pkioverlapperiod"),
    "guid": ("attributesecurityguid", "ms-ds-consistencyguid", "rightsguid", "schemaidguid"),
    "plain_guid": ("objectguid",),
    "sid": ("creatorsid", "ms-ds-creatorsid", "objectsid", "securityidentifier", "sidhistory"),
    "roaming": ("mspkiroamingtimestamp",),
    "descriptor": (
        "frsrootsecurity", "msdfs-linksecuritydescriptorv2", "msds-allowedtoactonbehalfofotheridentity", "msds-groupmsamembership", "ntsecuritydescriptor", "pkienrollmentaccess",
    ),
}
#: Edges of privileges; others lead nowhere. Fixed values.
PRIVILEGES = {
    "SeNetworkLogonRight": "SeNetworkLogonRight", "SeRemoteInteractiveLogonRight": "RDPRights", "SeBackupPrivilege": "SeBackupPrivilege", "SeRestorePrivilege": "SeRestorePrivilege",
    "SeAssignPrimaryTokenPrivilege": "SeAssignPrimaryToken", "SeCreateTokenPrivilege": "SeCreateToken", "SeDebugPrivilege": "SeDebug", "SeImpersonatePrivilege": "SeImpersonate",
    "SeLoadDriverPrivilege": "SeLoadDriver", "SeManageVolumePrivilege": "SeManageVolume", "SeTakeOwnershipPrivilege": "SeTakeOwnership",
    "SeTrustedCredManAccess": "SeTrustedCredManAccess", "SeTcbPrivilege": "SeTcb",
}
#: Edges of kinds of logons, and of the packages of those over the network: fixed values.
LOGONS = {2: "SessionLocal", 11: "SessionLocal", 3: "SessionNetwork", 4: "SessionBatch", 5: "SessionService", 10: "SessionRDP"}
PACKAGES = {
    "NTLM": "SessionNetworkNTLM", "NTLM V1": "SessionNetworkNTLM", "NTLM V2": "SessionNetworkNTLMV2", "Kerberos": "SessionNetworkKerberos", "Negotiate": "SessionNetworkNegotiate",
}
#: What members of built-in groups may do on their machine.
GROUP_RIGHTS = {"S-1-5-32-544": "AdminRights", "S-1-5-32-562": "DCOMRights", "S-1-5-32-555": "RDPRights"}


def _lookup(table: dict, key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _id(*parts):
    return F.xxhash64(*parts)


def by_look(s):
    """A text as a typed value: bool, then time, then int, then string."""
    low = F.lower(s)
    stamp = F.when(s.rlike(r"^\d{14}(\.0)?Z$"), F.try_to_timestamp(F.substring(s, 1, 14), F.lit("yyyyMMddHHmmss")))
    number = s.try_cast("bigint")
    named = F.when(stamp.isNotNull(), value("time", stamp)).when(number.isNotNull(), value("int", number)).otherwise(value("string", s))
    return F.when(low.isin("true", "false"), value("bool", low == "true")).otherwise(named)


def _filetime(s):
    """Ticks as a time; 0 stays a number, what is no number is dropped."""
    ticks = s.try_cast("bigint")
    return F.when(ticks == 0, value("int", ticks)).when(ticks.isNotNull(), value("time", names.filetime(ticks)))


def _generalized(s):
    plain = s.rlike(r"^(\d{14}|\d{12})(\.0)?Z?$")
    return F.when(plain & names.generalized_time(s).isNotNull(), value("time", names.generalized_time(s)))


def _bytes(s):
    """Bytes of a binary value, which JSON holds in base 64."""
    return F.try_to_binary(s, F.lit("base64"))


def _word(hexed, at: int, little: bool):
    """Eight bytes of a hex text, as a number; null of 2^63 and more."""
    order = range(7, -1, -1) if little else range(8)
    return F.conv(F.concat(*[hexed.substr(2 * (at + k) + 1, 2) for k in order]), 16, 10).try_cast("bigint")


def _period(s):
    """Eight bytes as a period; others as they stand."""
    raw = _bytes(s)
    text = F.when(F.octet_length(raw) == 8, names.pki_period(_word(F.hex(raw), 0, False)))
    return value("string", F.coalesce(text, s))


def _roaming(s):
    raw = _bytes(s)
    return F.when(F.octet_length(raw) >= 16, value("time", names.filetime(_word(F.hex(raw), 8, True))))


def _guid(s, plain: bool):
    """A GUID in its text form, or of 16 bytes."""
    raw = _bytes(s)
    of_bytes = names.plain_guid(F.hex(raw)) if plain else names.dotted_guid(F.hex(raw))
    dashed = s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return F.when(dashed, value("string", F.lower(s))).when(F.octet_length(raw) == 16, value("string", of_bytes))


def _sid_value(s):
    text = F.when(s.startswith("S-1-"), s).otherwise(names.binary_sid(_bytes(s)))
    return F.when(text.isNotNull(), value("string", text))


DECODERS = {
    "filetime": _filetime, "generalized": _generalized, "period": _period, "guid": lambda s: _guid(s, False), "plain_guid": lambda s: _guid(s, True),
    "sid": _sid_value, "roaming": _roaming, "descriptor": lambda s: value("string", s), "look": by_look,
}


def decoded(objects: DataFrame, key: str = "key") -> DataFrame:
    """objects (key, attributes map<string, array<string>>) -> (key, attrs): values decoded by the class of their attribute.

    The class of a name is looked up, each distinct (class, text) is decoded once, by the decoder of its class, and goes back to
    where it stood. Values that their decoder can't read are dropped, names without values too. Descriptors stay as they are,
    see descriptors()."""
    of_class = {name: kind for kind, listed in CLASSES.items() for name in listed}
    each = objects.select(key, F.explode("attributes").alias("name", "texts")).select(key, F.lower("name").alias("name"), F.posexplode("texts").alias("at", "text"))
    each = cut(each.where("text is not null").withColumn("kind", F.coalesce(_lookup(of_class, F.col("name")), F.lit("look"))), "values")
    distinct = each.select("kind", "text").distinct()
    typed = F.lit(None).cast(VALUE)
    for kind, decoder in DECODERS.items():
        typed = F.when(F.col("kind") == kind, decoder(F.col("text"))).otherwise(typed)
    readable = distinct.withColumn("value", typed).where("value is not null")
    listed = each.join(readable, ["kind", "text"]).groupBy(key, "name").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("values"))
    entry = F.struct(F.col("name").alias("key"), F.transform("values", lambda v: v["value"]).alias("value"))
    made = listed.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("attrs"))
    return objects.select(key).join(made, key, "left").withColumn("attrs", F.coalesce("attrs", F.create_map().cast(ATTRS)))


def directory_objects(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Nodes of directory objects (one JSON object a line, binary values in base 64); conflict and deleted entries, foreign
    principals and entries without a class are skipped. Values are typed by the class of their attribute, and the node's type
    is what the dump's own schema calls its category, see rules.schema_types()."""
    from ..operators.rules import schema_types

    raw = spark.read.schema(OBJECTS).option("recursiveFileLookup", True).json(path)
    keep = ~F.col("DistinguishedName").rlike(r"(?i)\\0A(CNF|DEL):|CN=ForeignSecurityPrincipals,") & (F.size(F.col("Attributes")["objectClass"]) > 0)
    objects = raw.where(keep).select(_id(F.lower("DistinguishedName")).alias("node_id"), F.col("DistinguishedName").alias("dn"), F.col("Attributes").alias("attributes"))
    objects = cut(objects.dropDuplicates(["node_id"]), "objects")
    own = attributes(distinguishedname=("string", F.col("dn")), datasource=("string", F.lit(source)), dataloader=("string", F.lit("Active Directory")))
    clean = F.map_filter("attrs", lambda k, _: ~k.isin("distinguishedname", "datasource", "dataloader"))
    joined = decoded(objects, "node_id").join(objects.select("node_id", "dn"), "node_id")
    nodes = joined.select("node_id", F.lit(None).cast("string").alias("type"), F.map_concat(clean, own).alias("attrs"), F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<string>").alias("tags"))
    return schema_types(cut(nodes, "nodes"))


def descriptors(nodes: DataFrame, attr: str = "ntsecuritydescriptor") -> DataFrame:
    """(node_id, type, descriptor, class_guids) of nodes with a security descriptor in attr, as access.access_edges() takes
    them. Many objects share one descriptor: each is parsed once."""
    from ..operators.access import parsed_descriptor
    from ..operators.rules import class_guids

    held = nodes.select("node_id", "type", F.col("attrs")[attr][0]["s"].alias("text")).where("text is not null")
    distinct = held.select("text").distinct().withColumn("descriptor", parsed_descriptor(_bytes(F.col("text")))).where("descriptor is not null")
    of_class = class_guids(nodes)
    joined = held.join(distinct, "text").join(of_class, "node_id", "left")
    return joined.select("node_id", "type", "descriptor", F.coalesce("class_guids", F.array().cast("array<string>")).alias("class_guids"))


def open_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of generic graph files; an edge's ends are found by id, or by the property that match_by names."""
    raw = spark.read.schema(OPEN_GRAPH).option("multiLine", True).json(path)
    n = raw.select(F.explode("graph.nodes").alias("n")).select(F.col("n.id").alias("key"), F.element_at("n.kinds", 1).alias("type"), F.col("n.properties").alias("p"))
    props = F.map_from_entries(F.transform(F.map_entries(F.coalesce("p", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.array(value("string", e["value"])).alias("value"))))
    nodes = n.select(_id("key").alias("node_id"), "type", F.map_concat(F.map_filter(props, lambda k, _: k != "objectid"), attributes(objectid=("string", F.col("key")))).alias("attrs"), F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<string>").alias("tags"))
    e = raw.select(F.posexplode("graph.edges").alias("pos", "e")).select("pos", "e.*").withColumn("row", F.monotonically_increasing_id())
    known = nodes.select("node_id", F.explode("attrs").alias("attr", "vals")).select("node_id", "attr", F.lower(F.col("vals")[0]["s"]).alias("low"))

    def end(which: str):
        by = F.coalesce(F.lower(f"{which}.match_by"), F.lit("id"))
        asked = e.select("row", F.when(by == "id", "objectid").otherwise(by).alias("attr"), F.lower(f"{which}.value").alias("low"))
        return asked.join(known, ["attr", "low"]).groupBy("row").agg(F.min("node_id").alias(which))

    edges = e.select("row", F.col("kind").alias("edge_type")).join(end("start"), "row").join(end("end"), "row").where("start <> end")
    return nodes, edges.select(F.col("start").alias("src"), F.col("end").alias("dst"), "edge_type", F.lit(100).alias("prob")).distinct()


def machines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Machine, local users and groups, memberships, what built-in groups and privileges allow, and sessions by the kind of logon,
    of telemetry files. Logons of ids outside domains and machines are skipped.

    A security id of a domain or machine (S-1-5-21-...) is one node; others, such as built-in groups, are one a machine."""
    raw = spark.read.schema(MACHINE).option("multiLine", True).json(path).withColumn("local", F.lower("Machine.LocalSID")).withColumn("host", _id("local"))
    sid = lambda c: F.when(F.col(c).startswith("S-1-5-21-"), _id(F.lower(c))).otherwise(_id("local", F.lower(c)))
    text = lambda c: ("string", F.col(c))
    no_tags = F.array().cast("array<string>").alias("tags")
    blank = lambda df, kind: df.select("node_id", F.lit(kind).alias("type"), "attrs", F.col("parent").alias("parent_id"), no_tags)
    about = attributes(name=text("Machine.Name"), objectsid=text("Machine.LocalSID"), wuserver=text("Machine.WUServer"), sccmserver=text("Machine.SCCMLastValidMP"))
    host = raw.select(F.col("host").alias("node_id"), about.alias("attrs"), F.lit(None).cast("bigint").alias("parent"))
    each = lambda column, name: raw.select("host", "local", F.explode(column).alias(name))
    person = attributes(name=text("u.Name"), objectsid=text("u.SID"), displayname=text("u.FullName"))
    users = each("Users", "u").select(sid("u.SID").alias("node_id"), person.alias("attrs"), F.col("host").alias("parent"))
    circle = attributes(name=text("g.Name"), objectsid=text("g.SID"), description=text("g.Comment"))
    groups = each("Groups", "g").select(sid("g.SID").alias("node_id"), circle.alias("attrs"), F.col("host").alias("parent"))
    nodes = blank(host, "Machine").union(blank(users, "User")).union(blank(groups, "Group"))

    def edge(df: DataFrame, kind) -> DataFrame:
        return df.where("src <> dst").select("src", "dst", kind.alias("edge_type"), F.lit(100).alias("prob")).distinct()

    held = each("Groups", "g").select("host", "local", "g", F.explode("g.Members").alias("m"))
    held = held.withColumn("member", F.coalesce(F.when(F.col("m.SID") != "", F.col("m.SID")), F.when(F.col("m.Name").startswith("S-1-"), F.col("m.Name")))).where("member is not null")
    member = held.select(sid("member").alias("src"), sid("g.SID").alias("dst"))
    right = F.when(F.col("g.Name") == "SMS Admins", "SMSAdmins").otherwise(_lookup(GROUP_RIGHTS, F.col("g.SID")))
    granted = held.select(sid("g.SID").alias("src"), F.col("host").alias("dst"), right.alias("kind")).where("kind is not null")
    own_kind = F.array(F.lit("Session"), _lookup(LOGONS, F.col("l.LogonType")), F.when(F.col("l.LogonType") == 3, _lookup(PACKAGES, F.col("l.AuthenticationPackageName"))))
    logon = each("LoginInfos", "l").where("l.SID like 'S-1-5-21-%'").select(F.col("host").alias("src"), sid("l.SID").alias("dst"), F.explode(F.array_compact(own_kind)).alias("kind"))
    assigned = each("Privileges", "p").select("host", "local", _lookup(PRIVILEGES, F.col("p.Name")).alias("kind"), F.explode("p.AssignedSIDs").alias("s"))
    rights = assigned.where("kind is not null").select(sid("s").alias("src"), F.col("host").alias("dst"), "kind")
    edges = edge(member, F.lit("MemberOfGroup"))
    for more in (granted, logon, rights):
        edges = edges.union(edge(more, F.col("kind")))
    return nodes, edges


def top_users(spark: SparkSession, path: str) -> DataFrame:
    """(host, user): whom most records of interactive logons (types 2 and 11) of each machine name, the later of equal ones.
    A domain with a dot makes user@domain, others domain\\user."""
    raw = spark.read.schema(MACHINE).option("multiLine", True).json(path)
    logon = raw.select(F.col("Machine.Name").alias("host"), F.explode("LoginInfos").alias("l")).where("l.LogonType in (2, 11) and l.SID like 'S-1-5-21-%'")
    user = F.when(F.col("l.Domain").contains("."), F.concat_ws("@", "l.User", "l.Domain")).otherwise(F.concat_ws("\\", "l.Domain", "l.User"))
    per = logon.groupBy("host", user.alias("user")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("host").agg(F.max_by("user", F.struct("n", "user")).alias("user"))


def policy_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """File nodes of policies and PartOfGPO edges; stored passwords of preference files as an attribute."""
    raw = spark.read.schema(POLICY).option("multiLine", True).json(path).withColumn("gpo", _id(F.lower("GUID")))
    f = raw.select("gpo", "GUID", F.explode("Files").alias("f")).withColumn("text", F.unbase64("f.Contents").cast("string"))
    node = _id("GUID", F.lower("f.RelativePath"))
    secret = F.regexp_extract_all("text", F.lit(r'cpassword="([^"]+)"'), 1)
    nodes = f.select(node.alias("node_id"), F.when(F.col("f.IsDir"), "Directory").otherwise("File").alias("type"), attributes(name=("string", F.col("f.RelativePath")), **{"cpassword": ("string[]", F.when(F.size(secret) > 0, secret))}).alias("attrs"), F.col("gpo").alias("parent_id"), F.array().cast("array<string>").alias("tags"))
    return nodes, f.select(node.alias("src"), F.col("gpo").alias("dst"), F.lit("PartOfGPO").alias("edge_type"), F.lit(100).alias("prob")).distinct()


def usernames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()
