"""Readers of collected files, sinks and the stream, on small files."""

import base64
import json
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from graphspark.operators import access, probability, rules
from graphspark.sources import files, sinks
from graphspark.streaming import ingest
from tests.test_rules import RESET, ace, descriptor, sid_bytes


@pytest.fixture
def folder(tmp_path):
    def write(name, *rows):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return str((tmp_path / name).parent)

    return write


def first(attr):
    return F.col("attrs")[attr][0]["s"].alias(attr)


def b64(raw):
    return base64.b64encode(raw).decode()


def category(name):
    return f"CN={name},CN=Schema,CN=Configuration,DC=x"


def schema(name, display, guid):
    """A class of the dump's own schema."""
    return {"DistinguishedName": category(name), "Attributes": {"objectClass": ["top", "classSchema"], "objectCategory": [category("Class-Schema")], "name": [name], "lDAPDisplayName": [display], "schemaIDGUID": [b64(uuid.UUID(guid).bytes_le)]}}


SCHEMA = [
    schema(n, d, f"00000000-0000-0000-0000-0000000000{i:02d}")
    for i, (n, d) in enumerate([("Class-Schema", "classSchema"), ("Person", "user"), ("Group", "group"), ("Computer", "computer"), ("Domain-DNS", "domainDNS"), ("Group-Policy-Container", "groupPolicyContainer"), ("Organizational-Unit", "organizationalUnit"), ("Odd-Thing", "oddThing")])
]


def thing(dn, kind, display, **attrs):
    return {"DistinguishedName": dn, "Attributes": {"objectClass": ["top", display], "objectCategory": [category(kind)]} | {k.replace("__", "-"): v if isinstance(v, list) else [v] for k, v in attrs.items()}}


def test_directory_objects(spark, folder):
    path = folder(
        "a/one.json", *SCHEMA,
        thing("CN=Bob,DC=x", "Person", "user", badPwdCount="3", whenCreated="20200102030405.0Z", isDeleted="FALSE", mail=["B@x", "b@y"], other="20200102030405.0Z"),
        thing("CN=Bob\\0ACNF:1,DC=x", "Person", "user"),
        {"DistinguishedName": "CN=S-1,CN=ForeignSecurityPrincipals,DC=x", "Attributes": {"objectClass": ["user"]}},
        {"DistinguishedName": "CN=NoClass,DC=x", "Attributes": {"mail": ["z"]}},
        {"DistinguishedName": "CN=Lost,DC=x", "Attributes": {"objectClass": ["user"], "objectCategory": ["CN=Gone"], "member": []}},
        thing("CN=Odd,DC=x", "Odd-Thing", "oddThing"),
    )
    rows = {r["attrs"]["distinguishedname"][0]["s"]: r for r in files.directory_objects(spark, path, "src").collect()}
    assert {dn: r["type"] for dn, r in rows.items() if "Schema" not in dn} == {"CN=Bob,DC=x": "User", "CN=Lost,DC=x": "Unknown", "CN=Odd,DC=x": "Odd-Thing"}
    assert {r["type"] for dn, r in rows.items() if "Schema" in dn} == {"ClassSchema"} and len(rows) == 3 + len(SCHEMA)
    a = {k: [(v["k"], v["s"]) for v in vs] for k, vs in rows["CN=Bob,DC=x"]["attrs"].items()}
    assert a["datasource"] == [("string", "src")] and a["dataloader"] == [("string", "Active Directory")]
    assert a["badpwdcount"] == [("int", "3")] and a["isdeleted"] == [("bool", "false")] and a["mail"] == [("string", "B@x"), ("string", "b@y")]
    assert a["whencreated"] == a["other"] and a["whencreated"][0][0] == "time" and a["whencreated"][0][1].startswith("2020-01-02T03:04:05")


def test_values_by_the_class_of_their_attribute(spark, folder):
    sid = bytes([1, 2]) + (5).to_bytes(6, "big") + struct.pack("<II", 32, 544)
    guid = uuid.UUID("00112233-4455-6677-8899-aabbccddeeff")
    ticks = 132223104000000000
    path = folder(
        "c/one.json",
        thing(
            "CN=A,DC=x", "Person", "user", objectSid=b64(sid), sIDHistory=["S-1-5-21-1", b64(sid), b64(sid[:9])], objectGUID=b64(guid.bytes), schemaIDGUID=b64(guid.bytes_le), rightsGUID=str(guid).upper(),
            pwdLastSet=str(ticks), accountExpires="0", lastLogon="never", whenChanged="990506070809Z", whenCreated="2020", pKIExpirationPeriod=b64((2 * 31536000 * 10**7).to_bytes(8, "big")), pKIOverlapPeriod="x",
            msPKIRoamingTimeStamp=b64(bytes(8) + struct.pack("<Q", ticks)), count="12", flag="TRUE", text="12a", stamp="20200102030405.5Z", nTSecurityDescriptor=b64(b"raw"),
        ),
    )
    row = files.directory_objects(spark, path, "s").first()["attrs"]
    got = {k: [(v["k"], v["s"]) for v in vs] for k, vs in row.items()}
    text = lambda *values: [("string", v) for v in values]
    assert got["objectsid"] == text("S-1-5-32-544") and got["sidhistory"] == text("S-1-5-21-1", "S-1-5-32-544")
    assert got["objectguid"] == got["schemaidguid"] == got["rightsguid"] == text(str(guid))
    assert got["pwdlastset"][0][0] == "time" and got["pwdlastset"][0][1].startswith("2020-01-01T00:00:00") and got["mspkiroamingtimestamp"] == got["pwdlastset"]
    assert got["accountexpires"] == [("int", "0")] and "lastlogon" not in got and "whencreated" not in got
    assert got["whenchanged"][0][1].startswith("1999-05-06T07:08:09") and got["pkiexpirationperiod"] == text("2 years") and got["pkioverlapperiod"] == text("x")
    assert got["count"] == [("int", "12")] and got["flag"] == [("bool", "true")] and got["text"] == text("12a") and got["stamp"] == text("20200102030405.5Z")
    assert got["ntsecuritydescriptor"] == text(b64(b"raw"))


def test_from_a_dump_to_rated_edges(spark, folder):
    """Reader, rules, access lists and probabilities, one after the other."""
    domain = "S-1-5-21-1-2-3"
    raw = lambda text: b64(sid_bytes(text))
    shared = b64(descriptor(f"{domain}-512", [ace(5, 0, 0x100, f"{domain}-1001", RESET), ace(0, 0, 0x40000, f"{domain}-1002")]))
    path = folder(
        "d/dump.json", *SCHEMA,
        thing("DC=x", "Domain-DNS", "domainDNS", objectSid=raw(domain), gPLink="[LDAP://cn=p1,DC=x;0][LDAP://cn=p2,DC=x;2]"),
        thing("OU=u,DC=x", "Organizational-Unit", "organizationalUnit", gPOptions="1"),
        thing("CN=p1,DC=x", "Group-Policy-Container", "groupPolicyContainer"), thing("CN=p2,DC=x", "Group-Policy-Container", "groupPolicyContainer"),
        thing("CN=Admins,DC=x", "Group", "group", objectSid=raw(f"{domain}-512"), member=["CN=Ann,OU=u,DC=x"]),
        thing("CN=Ann,OU=u,DC=x", "Person", "user", objectSid=raw(f"{domain}-1001"), userAccountControl="512", servicePrincipalName="http/a", pwdLastSet="132223104000000000"),
        thing("CN=Ben,OU=u,DC=x", "Person", "user", objectSid=raw(f"{domain}-1002"), userAccountControl="514", nTSecurityDescriptor=shared),
        thing("CN=H,OU=u,DC=x", "Computer", "computer", objectSid=raw(f"{domain}-1100"), userAccountControl="4096", dNSHostName="h.x", name="H", nTSecurityDescriptor=shared),
    )
    nodes = rules.parents_by_dn(rules.domain_contexts(files.directory_objects(spark, path, "s")))
    new, machine_edges = rules.machine_accounts(nodes, 1 << 60)
    nodes = rules.account_ages(rules.account_tags(nodes, "2024-01-01"), "2024-01-01").unionByName(new)
    who = nodes.select("node_id", F.col("attrs")["objectsid"][0]["s"].alias("sid")).where("sid is not null")
    made = [rules.memberships(nodes), rules.policy_links(nodes), machine_edges, access.access_edges(files.descriptors(nodes), who), rules.roastable(nodes, 7)]
    edges = made[0]
    for more in made[1:]:
        edges = edges.union(more)
    called = {r["node_id"]: r["n"] for r in nodes.select("node_id", F.concat("type", F.lit(" "), F.regexp_extract(F.coalesce(F.col("attrs")["distinguishedname"][0]["s"], F.lit("CN=H")), "^..=([^,]*)", 1)).alias("n")).collect()} | {7: "all"}
    got = {(called[r["src"]], called[r["dst"]], r["edge_type"], r["prob"]) for r in probability.rated(edges, nodes).collect()}
    assert got == {
        ("User Ann", "Group Admins", "MemberOfGroup", 100), ("GroupPolicyContainer p2", "Machine H", "AffectedByGPO", 100),
        ("Machine H", "Computer H", "MachineAccount", -1), ("Machine H", "Computer H", "AuthenticatesAs", 100),
        ("Group Admins", "User Ben", "Owns", 100), ("Group Admins", "Computer H", "Owns", 100),
        ("User Ann", "User Ben", "ResetPassword", 0), ("User Ann", "Computer H", "ResetPassword", 100),
        ("User Ben", "Computer H", "WriteDACL", 100), ("all", "User Ann", "HasSPN", 32),
    }


def test_open_graph(spark, folder):
    nodes = [{"id": "a", "kinds": ["Host"], "properties": {"name": "Alpha"}}, {"id": "b", "kinds": ["User", "X"], "properties": {"name": "Beta"}}]
    edge = lambda s, e, k: {"start": s, "end": e, "kind": k}
    edges = [edge({"value": "A"}, {"match_by": "name", "value": "beta"}, "Owns"), edge({"value": "a"}, {"value": "a"}, "Self"), edge({"value": "a"}, {"value": "zz"}, "Gone")]
    path = folder("g/x.json", {"metadata": {"v": "1"}, "graph": {"nodes": nodes, "edges": edges}})
    n, e = files.open_graph(spark, path)
    by_name = {r["name"]: (r["node_id"], r["type"], r["objectid"]) for r in n.select("node_id", "type", first("name"), first("objectid")).collect()}
    assert by_name["Alpha"][1:] == ("Host", "a") and by_name["Beta"][1:] == ("User", "b")
    assert [(r["src"], r["dst"], r["edge_type"]) for r in e.collect()] == [(by_name["Alpha"][0], by_name["Beta"][0], "Owns")]


def machine():
    member = {"Name": "u", "SID": "S-1-5-21-9-9-9-1001"}
    return {
        "Machine": {"Name": "HOST", "LocalSID": "S-1-5-21-9-9-9", "WUServer": "http://wu"},
        "Users": [{"Name": "u", "SID": "S-1-5-21-9-9-9-1001", "FullName": "U"}],
        "Groups": [{"Name": "Administrators", "SID": "S-1-5-32-544", "Members": [member]}, {"Name": "G", "SID": "S-1-5-21-9-9-9-1002", "Members": [member]}],
        "LoginInfos": [
            {"User": "u", "Domain": "D", "SID": "S-1-5-21-9-9-9-1001", "Count": 2, "LogonType": 2}, {"User": "v", "Domain": "D", "SID": "S-9", "Count": 9, "LogonType": 3},
            {"User": "w", "Domain": "D", "SID": "S-1-5-21-7-7-7-1", "Count": 9, "LogonType": 3, "AuthenticationPackageName": "NTLM V2"},
            {"User": "x", "Domain": "d.x", "SID": "S-1-5-21-7-7-7-2", "Count": 1, "LogonType": 11}, {"User": "x", "Domain": "d.x", "SID": "S-1-5-21-7-7-7-2", "Count": 1, "LogonType": 2},
        ],
        "Privileges": [{"Name": "SeDebugPrivilege", "AssignedSIDs": ["S-1-5-32-544"]}],
    }


def test_machines_and_their_top_users(spark, folder):
    path = folder("m/h.json", machine())
    n, e = files.machines(spark, path)
    ids = {r["objectsid"]: r["node_id"] for r in n.select("node_id", first("objectsid")).collect()}
    assert n.groupBy("type").count().orderBy("type").collect() == [("Group", 2), ("Machine", 1), ("User", 1)]
    host, user, admins, group = ids["S-1-5-21-9-9-9"], ids["S-1-5-21-9-9-9-1001"], ids["S-1-5-32-544"], ids["S-1-5-21-9-9-9-1002"]
    got = {(r["src"], r["dst"], r["edge_type"]) for r in e.collect()}
    assert {(user, admins, "MemberOfGroup"), (user, group, "MemberOfGroup"), (admins, host, "AdminRights"), (host, user, "Session"), (host, user, "SessionLocal"), (admins, host, "SeDebug")} <= got
    others = {e for e in got if e[0] == host and e[1] != user}
    assert sorted(e[2] for e in others) == ["Session", "Session", "SessionLocal", "SessionNetwork", "SessionNetworkNTLMV2"] and len(got) == 6 + len(others)
    assert [tuple(r) for r in files.top_users(spark, path).collect()] == [("HOST", "x@d.x")]


def test_built_in_groups_are_those_of_their_machine(spark, folder):
    other = machine() | {"Machine": {"Name": "H2", "LocalSID": "S-1-5-21-8-8-8"}}
    folder("two/h.json", machine())
    path = folder("two/h2.json", other)
    n, _ = files.machines(spark, path)
    ids = n.select("node_id", first("objectsid")).distinct().collect()
    assert sum(r["objectsid"] == "S-1-5-32-544" for r in ids) == 2 and sum(r["objectsid"] == "S-1-5-21-9-9-9-1001" for r in ids) == 1


def test_policy_files_and_names(spark, folder):
    text = base64.b64encode(b'<Groups cpassword="abc=" x="1"/>').decode()
    path = folder("p/g.json", {"GUID": "{1}", "DomainDN": "DC=x", "Files": [{"RelativePath": "Machine/Groups.xml", "Contents": text, "IsDir": False}, {"RelativePath": "Machine", "IsDir": True}]})
    n, e = files.policy_files(spark, path)
    rows = {r["name"]: (r["type"], r["cpassword"]) for r in n.select("type", first("name"), first("cpassword")).collect()}
    assert rows == {"Machine/Groups.xml": ("File", "abc="), "Machine": ("Directory", None)}
    assert {(r["src"], r["edge_type"]) for r in e.collect()} == {(r["node_id"], "PartOfGPO") for r in n.collect()}
    names = folder("u/names.txt", " bob ", "", "eve", "bob")
    assert sorted(r["name"] for r in files.usernames(spark, names).collect()) == ["bob", "eve"]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "start"), (2, None)], "node_id long, reference string")
    edges = spark.createDataFrame([(1, 2, ["A", "B"], 3)], "src long, dst long, edge_types array<string>, flow long")
    assert sorted(r["line"] for r in sinks.graphviz(nodes, edges).collect()) == ['"1" -> "2" [label="A, B"];', '"1";', '"2";']
    assert [tuple(r) for r in sinks.xgmml_edges(edges).collect()] == [(1, 2, "A, B", 3)]
    all_nodes = spark.createDataFrame([(1, "T"), (2, "T")], "node_id long, type string").withColumn("attrs", F.expr("map('name', array(named_struct('k', 'string', 's', concat('n', node_id), 'i', cast(null as bigint), 'f', cast(null as double), 't', cast(null as timestamp), 'b', cast(null as boolean))))"))
    got = [json.loads(r["json"]) for r in sinks.elements(nodes, edges, all_nodes).collect()]
    assert {"group": "nodes", "data": {"id": "n1", "label": "n1", "type": "T", "reference": "start"}} in got
    assert {"group": "edges", "data": {"id": "e1-2", "source": "n1", "target": "n2", "flow": 3, "methods": ["A", "B"]}} in got and len(got) == 3
    sinks.write_lines(sinks.graphviz(nodes, edges), str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).count() == 3


def test_stream_of_edges(spark, tmp_path):
    rows = [(1, 2, "A", 10, "2024-01-01 00:10:00"), (1, 2, "B", 30, "2024-01-01 00:50:00"), (1, 2, "A", 20, "2024-01-01 01:10:00"), (3, 3, "A", 9, "2024-01-01 01:00:00"), (5, 6, "A", 9, "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "src long, dst long, edge_type string, prob int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(7, 8, "A", 1, "2024-01-01 20:00:00")], "src long, dst long, edge_type string, prob int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = str(tmp_path / "out")
    ingest.write_pairs(ingest.windowed_pairs(ingest.read_edges(spark, str(tmp_path / "in"))), out, str(tmp_path / "cp")).awaitTermination(60)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark, which closes the earlier windows
    ingest.write_pairs(ingest.windowed_pairs(ingest.read_edges(spark, str(tmp_path / "in"))), out, str(tmp_path / "cp")).awaitTermination(60)
    got = {(str(r["start"]), r["src"], r["dst"]): (r["n"], r["prob"]) for r in spark.read.parquet(out).collect()}
    assert got[("2024-01-01 00:00:00", 1, 2)] == (2, 30) and got[("2024-01-01 01:00:00", 1, 2)] == (1, 20)
    assert not any(k[1] == k[2] for k in got)
