"""Edge rules, access lists, merging and names on small fixtures, against results worked out by hand."""

import struct
import uuid

import pytest
from pyspark.sql import functions as F

from graphspark.functions import names
from graphspark.functions.values import VALUE, attributes, value
from graphspark.operators import access, merge, paths, rules
from graphspark.operators import graph as g
from graphspark.plans.pattern import Edge, Node, Pattern


def make(spark, rows):
    """rows (id, type, parent, {attr: text, int or list of them}) -> nodes."""
    flat = []
    for node, kind, parent, attrs in rows:
        entries = {}
        for k, v in attrs.items():
            entries[k] = [str(x) for x in (v if isinstance(v, list) else [v])]
        flat.append((node, kind, parent, entries))
    df = spark.createDataFrame(flat, "node_id long, type string, parent_id long, a map<string,array<string>>")
    typed = F.transform_values("a", lambda _, v: F.transform(v, lambda x: F.when(x.try_cast("bigint").isNotNull(), value("int", x.try_cast("bigint"))).otherwise(value("string", x))))
    return df.select("node_id", "type", typed.cast(f"map<string,array<{VALUE}>>").alias("attrs"), "parent_id", F.array().cast("array<string>").alias("tags"))


def pairs(edges):
    return {(r["src"], r["dst"], r["edge_type"]) for r in edges.collect()}


# ---- descriptors ----
def sid_bytes(text):
    parts = [int(x) for x in text.split("-")[2:]]
    return bytes([1, len(parts) - 1]) + parts[0].to_bytes(6, "big") + b"".join(struct.pack("<I", x) for x in parts[1:])


def ace(kind, flags, mask, sid, guid=None):
    body = struct.pack("<I", mask)
    if kind in (5, 6):
        body += struct.pack("<I", 1 if guid else 0) + (guid or b"")
    body += sid_bytes(sid)
    return struct.pack("<BBH", kind, flags, 4 + len(body)) + body


def descriptor(owner, aces, control=0x8004):
    acl = struct.pack("<BBHHH", 2, 0, 8 + sum(map(len, aces)), len(aces), 0) + b"".join(aces)
    o = sid_bytes(owner)
    return struct.pack("<BBHIIII", 1, 0, control, 20, 0, 0, 20 + len(o)) + o + acl


A, B, C = "S-1-5-21-1-2-3-1105", "S-1-5-21-1-2-3-1200", "S-1-5-21-1-2-3-1300"
RESET = uuid.UUID("00299570-246d-11d0-a768-00aa006e0529").bytes_le


def test_descriptors_are_read_and_put_in_order(spark):
    raw = descriptor(C, [ace(0, 0x10, 0x40000, A), ace(1, 0x10, 0x40000, B), ace(5, 0, 0x100, B, RESET), ace(1, 0, 0x100, A)])
    row = spark.createDataFrame([(raw,), (b"short",), (None,)], "raw binary").select(access.parsed_descriptor(F.col("raw")).alias("d")).collect()
    d = row[0]["d"]
    assert row[1]["d"] is None and row[2]["d"] is None
    assert d["owner"] == C and d["control"] == 0x8004
    assert [(a["ord"], a["type"], a["sid"]) for a in d["dacl"]] == [(0, 1, A), (1, 5, B), (2, 1, B), (3, 0, A)]
    assert d["dacl"][1]["object_type"] == "00299570-246d-11d0-a768-00aa006e0529"


def objects_of(spark, rows):
    df = spark.createDataFrame(rows, "node_id long, type string, raw binary, class_guids array<string>")
    return df.withColumn("descriptor", access.parsed_descriptor(F.col("raw")))


def test_rights_of_single_entries(spark):
    who = spark.createDataFrame([(1, A), (2, B), (3, C)], "node_id long, sid string")
    rows = [
        (10, "User", descriptor(C, [ace(0, 0, 0x40000, B)]), []),
        (11, "User", descriptor(C, [ace(5, 0, 0x100, A, RESET)]), []),
        (12, "OrganizationalUnit", descriptor(C, [ace(5, 0, 0x100, A, RESET)]), []),
        (13, "User", descriptor(C, [ace(0, 8, 0x40000, B)]), []),  # inherit-only
        (14, "DomainDNS", descriptor(C, [ace(0, 0, 0x100, A)]), []),
        (15, "User", descriptor(C, [ace(0, 0, 0x40000, A), ace(1, 0, 0x40000, A)]), []),  # put in order, the denial is first
        (16, "CertificateTemplate", descriptor(C, [ace(0, 0, 0x1000, A)]), []),
    ]
    got = pairs(access.access_edges(objects_of(spark, rows), who))
    assert (2, 10, "WriteDACL") in got and (1, 11, "ResetPassword") in got and (1, 12, "ResetPassword") not in got
    assert not {e for e in got if e[1] == 13 and e[2] != "Owns"}
    assert {e[2] for e in got if e[:2] == (1, 14)} == {"AllExtendedRights", "DSReplGetChngs", "DSReplGetChngsAll", "DSReplGetChngsInFiltSet", "DSReplSync"}
    assert {e[2] for e in got if e[:2] == (1, 15)} == {"ACLContainsDeny"}
    assert {e[2] for e in got if e[:2] == (1, 16)} == {"CertificateEnroll", "CertificateAutoEnroll", "VoodooBit"}
    assert {e for e in got if e[2] == "Owns"} == {(3, n, "Owns") for n in range(10, 17)}
    assert pairs(access.sync_rights(access.access_edges(objects_of(spark, rows), who))) == {(1, 14, "DCsync")}


def test_attribute_sets_grant_their_attributes(spark):
    who = spark.createDataFrame([(1, A)], "node_id long, sid string")
    rows = [(10, "Group", descriptor(C, [ace(5, 0, 0x20, A, uuid.UUID("bc0ac240-79a9-11d0-9020-00c04fc2d4cf").bytes_le)]), [])]
    schema = spark.createDataFrame([("BF9679C0-0DE6-11D0-A285-00AA003049E2", "bc0ac240-79a9-11d0-9020-00c04fc2d4cf")], "guid string, set_guid string")
    assert pairs(access.access_edges(objects_of(spark, rows), who)) == {(1, 10, "AddMemberGroupAttr")}
    assert pairs(access.access_edges(objects_of(spark, rows), who, schema=schema)) == {(1, 10, "AddMemberGroupAttr"), (1, 10, "AddMember")}


def test_inheritance_and_password_readers(spark):
    nodes = make(spark, [
        (1, "OrganizationalUnit", None, {}), (2, "Computer", 1, {"objectsid": "S-9", "name": "H", "ms-mcs-admpwdexpirationtime": "x"}), (3, "Computer", 1, {"objectsid": "S-8"}), (4, "ForeignSecurityPrincipal", 1, {}),
    ])
    raw = [(2, "Computer", descriptor(A, [ace(0, 0, 0x100, B)]), []), (3, "Computer", descriptor(A, [], 0x9004), []), (4, "ForeignSecurityPrincipal", descriptor(A, []), [])]
    objects = objects_of(spark, raw)
    assert pairs(rules.inherits_security(objects, nodes)) == {(1, 2, "InheritsSecurity")}
    new, links = rules.machine_accounts(nodes, 1000)
    assert new.count() == 2 and {r["dst"] for r in links.collect()} == {2, 3}
    who = spark.createDataFrame([(7, B)], "node_id long, sid string")
    granted = access.access_edges(objects, who, [("Laps", ("Computer",), "DS_CONTROL_ACCESS", "f3531ec6-6330-4f8e-8d39-7a671fbac605")]).where("edge_type = 'Laps'")
    got = rules.password_readers(granted, links, rules.managed_accounts(nodes)).collect()
    machine = links.where("dst = 2").select("src").first()[0]
    assert [(r["src"], r["dst"], r["edge_type"]) for r in got] == [(7, machine, "ReadLAPSPassword")]


# ---- rules ----
def test_small_rules(spark):
    nodes = make(spark, [
        (1, "GroupPolicyContainer", None, {}), (2, "Container", 1, {"name": "Machine"}), (3, "Container", 1, {"name": "Other"}),
        (4, "User", None, {"name": "MSOL_1", "description": "Account created by X with installation identifier 0af running on computer HOST1 configured to synchronize to tenant t. "}),
        (5, "Machine", None, {"name": "host1", "dnshostname": "host1.a.b", "datasource": "src1", "localmachinesid": "S-1-5-21-7-7-7"}),
        (6, "User", None, {"useraccountcontrol": 0x1000000, "msds-allowedtodelegateto": ["cifs/HOST1", "http/host1.a.b:80", "bad", "x/y/z"], "domaincontext": "DC=a,DC=b"}),
        (7, "User", None, {"datasource": "SRC1", "objectsid": "S-1-5-21-7-7-7-1001"}), (8, "User", None, {"objectsid": "S-1-5-21-7-7-7-1002"}),
        (9, "User", None, {"objectsid": "S-1-5-21-7-7-7-1003", "primarygroupid": 513}), (10, "Group", None, {"objectsid": "s-1-5-21-7-7-7-513"}),
    ])
    assert pairs(rules.policy_parts(nodes)) == {(1, 2, "PartOfGPO")}
    assert pairs(rules.sync_accounts(nodes)) == {(5, 4, "SessionService")}
    assert pairs(rules.constrained_delegation(nodes)) == {(6, 5, "CD")}
    assert {r["node_id"]: r["parent_id"] for r in rules.local_parents(nodes).where("type = 'User'").collect()} == {4: None, 6: None, 7: 5, 8: None, 9: None}
    assert pairs(rules.primary_groups(nodes)) == {(9, 10, "MemberOfGroup")}
    edges = spark.createDataFrame([(7, 8, "X", 100)], "src long, dst long, edge_type string, prob int")
    assert {r[0] for r in rules.unlinked(nodes, edges).collect()} == {9, 10}


def test_domains_trusts_and_foreign_identities(spark):
    nodes = make(spark, [
        (1, "DomainDNS", None, {"objectclass": ["top", "domainDNS"], "distinguishedname": "DC=a", "objectsid": "S-1-5-21-1-1-1", "domaincontext": "DC=a"}),
        (2, "DomainDNS", None, {"objectclass": "domainDNS", "distinguishedname": "DC=b", "objectsid": "S-1-5-21-2-2-2", "domaincontext": "DC=b"}),
        (3, "CrossRef", None, {"objectclass": "crossRef", "ncname": "DC=A", "netbiosname": "AA", "dnsroot": "A.example"}),
        (4, "User", None, {"objectsid": "S-1-5-21-1-1-1-500", "domaincontext": "DC=a"}),
        (5, "ForeignSecurityPrincipal", None, {"objectsid": "S-1-5-21-1-1-1-500", "domaincontext": "DC=b"}),
        (6, "Trust", None, {"domaincontext": "DC=a", "trustpartner": "b.example", "trustdirection": 3, "trustattributes": 0x48}),
        (7, "Trust", None, {"domaincontext": "DC=a", "trustpartner": "c.example", "trustdirection": 1}),
        (8, "User", None, {"objectsid": "S-1-5-32-544"}),
    ])
    assert [tuple(r) for r in rules.domains(nodes).collect()] == [("DC=a", "AA", "A.example", "S-1-5-21-1-1-1")]
    assert pairs(rules.foreign_identities(nodes)) == {(4, 5, "ForeignIdentity")}
    assert {tuple(r) for r in rules.trusts(nodes).collect()} == {("a.example", "b.example", "bidirectional", False), ("a.example", "c.example", "incoming", True)}
    assert {tuple(r) for r in rules.trust_map(nodes).collect()} == {("a.example", "b.example", True, True), ("a.example", "c.example", True, False)}
    known = spark.createDataFrame([("S-1-5-32-544", "Administrators"), ("S-1-1-0", "Everyone")], "sid string, name string")
    assert {r[0] for r in rules.missing_known(nodes, known, 10**6).select(F.col("attrs")["name"][0]["s"]).collect()} == {"Everyone"}
    assert rules.known_names(nodes, known).where("node_id = 8").select(F.col("attrs")["displayname"][0]["s"]).first()[0] == "Administrators"


def test_templates_classes_and_group_names(spark):
    nodes = make(spark, [
        (1, "PKIEnrollmentService", None, {"distinguishedname": "CN=CA", "dnshostname": "ca.a", "domaincontext": "DC=a", "certificatetemplates": ["Web", "Gone"]}),
        (2, "CertificateTemplate", None, {"objectclass": "pKICertificateTemplate", "name": "web", "domaincontext": "dc=A"}),
        (3, "CertificateTemplate", None, {"objectclass": "pKICertificateTemplate", "name": "web", "domaincontext": "DC=z"}),
        (4, "ClassSchema", None, {"ldapdisplayname": "user", "schemaidguid": "AB"}), (5, "User", None, {"objectclass": ["top", "USER"]}),
        (6, "GroupPolicyContainer", None, {}), (7, "Group", None, {"samaccountname": "Admins of %ComputerName%"}),
        (8, "Computer", None, {"downlevellogonname": "DOM\\PC1$"}), (9, "Group", None, {"downlevellogonname": "dom\\admins of pc1"}),
    ])
    assert [tuple(r) for r in rules.published_templates(nodes).collect()] == [(2, "CN=CA", "ca.a")]
    assert [(r[0], r[1]) for r in rules.class_guids(nodes).collect()] == [(5, ["ab"])]
    edges = spark.createDataFrame([(7, 6, "AdminRights", 100), (6, 8, "AffectedByGPO", 100)], "src long, dst long, edge_type string, prob int")
    assert pairs(rules.expanded_groups(edges, nodes)) == {(9, 8, "AdminRights")}


# ---- merging ----
def into(spark, rows, *args, **kw):
    m = {r["node_id"]: r["into"] for r in merge.merge_map(make(spark, rows), *args, **kw).collect()}
    return {r[0]: m.get(r[0], r[0]) for r in rows}


def test_merging_keeps_conflicts_apart_and_loses_no_link(spark):
    rows = [(1, "A", None, {"k": "x"}), (2, "B", None, {"k": "X"}), (3, "B", None, {"k": "x"})]
    assert into(spark, rows, ("k",)) == {1: 1, 2: 2, 3: 2}
    rows = [(1, None, None, {"k": "x"}), (2, "A", None, {"k": "x"}), (3, "B", None, {"k": "x"})]
    assert into(spark, rows, ("k",)) == {1: 1, 2: 1, 3: 3}
    # an untyped node between two types: it joins one, and what it brings along does not join the other
    rows = [(1, "A", None, {"k": "x"}), (2, None, None, {"k": ["x", "y"]}), (3, "B", None, {"k": "y"}), (4, None, None, {"k": "y"})]
    assert into(spark, rows, ("k",)) == {1: 1, 2: 1, 3: 3, 4: 3}
    rows = [(1, None, None, {"k": "x"}), (2, None, None, {"k": ["x", "y"]}), (3, None, None, {"k": "y", "s": "1"}), (4, None, None, {"k": "y", "s": "2"})]
    got = into(spark, rows, ("k",), ("s",))
    assert got[3] != got[4] and got[1] == got[2]


def test_machines_sources_and_equal_names(spark):
    rows = [(1, "Machine", None, {"k": "x"}), (2, None, None, {"k": "x"}), (3, "Machine", None, {"k": "x"})]
    assert into(spark, rows, ("k",)) == {1: 1, 2: 2, 3: 1}
    rows = [(1, "User", None, {"k": "x", "ds": "s"}), (2, "User", None, {"k": "x"}), (3, "User", None, {"k": "x"})]
    assert into(spark, rows, ("k",), sourced="ds") == {1: 1, 2: 2, 3: 2}
    rows = [(1, "User", None, {"distinguishedname": "CN=Shared", "displayname": "a"}), (2, "Group", None, {"distinguishedname": "cn=shared", "description": "b"})]
    assert into(spark, rows, ("k",), always=("distinguishedname",)) == {1: 1, 2: 1}
    n = make(spark, rows)
    one = merge.merge_nodes(n, merge.merge_map(n, ("k",), always=("distinguishedname",))).collect()
    assert len(one) == 1 and {"displayname", "description"} <= set(one[0]["attrs"])
    assert into(spark, [(1, "A", None, {}), (2, None, None, {})], ("k",)) == {1: 1, 2: 2}


def test_orphans_and_unique_values(spark):
    n = make(spark, [(1, "Root", None, {}), (2, "A", 1, {}), (3, "A", None, {})])
    assert {r["node_id"]: r["parent_id"] for r in merge.adopt_orphans(n, 1).collect()} == {1: None, 2: 1, 3: 1}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "node_id long, k string")
    assert [r["node_id"] for r in merge.unique_values(rows, "k").collect()] == [1]


# ---- paths ----
def path_graph(spark, links):
    e = spark.createDataFrame([(a, b, "Link", 100) for a, b in links], "src long, dst long, edge_type string, prob int")
    ids = sorted({x for ab in links for x in ab})
    return g.PropertyGraph(spark.createDataFrame([(i,) for i in ids], "node_id long"), e)


def found(result):
    return {(r["src"], r["dst"]): r["flow"] for r in result.edges.collect()}


def test_modes_tell_cycles_apart(spark):
    one, any_node = Node(F.col("node_id") == 1), Node()
    both = path_graph(spark, [(1, 2), (2, 1)])
    back = lambda mode, n: Pattern((one, Edge(("Link",), min_hops=n, max_hops=n), one), mode=mode)
    assert found(paths.match(both, back("WALK", 2))) == {(1, 2): 1, (2, 1): 1}
    assert found(paths.match(both, back("TRAIL", 2))) == {(1, 2): 1, (2, 1): 1}
    assert found(paths.match(both, back("ACYCLIC", 2))) == {} == found(paths.match(both, back("SIMPLE", 2)))
    undirected = path_graph(spark, [(1, 2)])
    there = lambda mode: Pattern((one, Edge(("Link",), "any", 2, 2), one), mode=mode)
    assert found(paths.match(undirected, there("WALK"))) == {(1, 2): 2} and found(paths.match(undirected, there("TRAIL"))) == {}
    eight = path_graph(spark, [(1, 2), (2, 1), (1, 3), (3, 1)])  # a trail may pass node 1 twice, a simple path may not
    trail = found(paths.match(eight, Pattern((one, Edge(("Link",), min_hops=4, max_hops=4), any_node), mode="TRAIL")))
    assert set(trail) == {(1, 2), (2, 1), (1, 3), (3, 1)}


def test_walks_honour_the_depth_or_refuse(spark):
    chain, one = path_graph(spark, [(1, 2), (2, 3), (3, 4)]), Node(F.col("node_id") == 1)
    walk = Pattern((one, Edge(("Link",), max_hops=3), Node()), mode="WALK", max_depth=1)
    assert found(paths.match(chain, walk)) == {(1, 2): 1}
    assert found(paths.match(chain, Pattern((one, Edge(("Link",), max_hops=3), Node()), mode="TRAIL", max_depth=1))) == {(1, 2): 1}
    with pytest.raises(ValueError, match="accumulated"):
        paths.match(chain, Pattern((one, Edge(("Link",)), Node()), mode="WALK", min_accumulated=0.5))
    with pytest.raises(ValueError, match="max_depth"):
        paths.match(chain, Pattern((one, Edge(max_hops=2), Node(), Edge(max_hops=2), Node()), mode="WALK", max_depth=3))


def test_level_rule_drops_what_enters_shorter_paths(spark):
    diamond, one = path_graph(spark, [(1, 2), (1, 3), (2, 3), (3, 4)]), Node(F.col("node_id") == 1)
    plain = found(paths.match(diamond, Pattern((one, Edge(("Link",), max_hops=3), Node()))))
    level = found(paths.match(diamond, Pattern((one, Edge(("Link",), max_hops=3), Node()), dedup="level")))
    assert plain == {(1, 2): 3, (1, 3): 2, (2, 3): 2, (3, 4): 2} and level == {(1, 2): 1, (1, 3): 2, (3, 4): 1}


def test_names(spark):
    df = spark.createDataFrame([("CN=a\\,b,OU=x,DC=y", "DC=Y,DC=z")], "dn string, ctx string")
    r = df.select(names.dn_parent(F.col("dn")).alias("up"), names.domain_suffix(F.col("ctx")).alias("suffix")).first()
    assert r["up"] == "OU=x,DC=y" and r["suffix"] == "y.z"
    one = spark.range(1).select(attributes(a=("string", F.lit("x"))).alias("attrs")).select(names.primary_id().alias("p"), names.label().alias("l")).first()
    assert one["p"] is None and one["l"] is None


def test_minima_decide_as_entries_in_order_do(spark):
    """All rights of random lists, against the entries taken one after the other."""
    import random

    rng = random.Random(7)
    about = [None, *{g for *_, g in access.RIGHTS if g}]
    masks = [*access.MASKS.values(), 0x120, 0x30]
    rows, want = [], set()
    for n in range(120):
        kind = rng.choice(["User", "Group", "DomainDNS", "CertificateTemplate"])
        entries = [(i, rng.choice([0, 1, 5, 6, 9, 2]), rng.choice([0, 0, 8]), 0, rng.choice(masks), rng.choice("xyz"), rng.choice(about), rng.choice([None, None, "C1", "c2"]), None) for i in range(rng.randint(0, 12))]
        rows.append((n, kind, (0, None, None, entries), ["c1"]))
        for edge, types, mask, guid in access.RIGHTS:
            for sid in "xyz":
                for _, t, flags, _, m, s, o, inherited, _ in entries if not types or kind in types else ():
                    if s == sid and t in (0, 1, 5, 6, 9) and not flags & 8 and m & access.MASKS[mask] == access.MASKS[mask] and (o is None or o == guid) and (inherited is None or inherited.lower() == "c1"):
                        if t not in (1, 6):
                            want.add((ord(sid), n, edge))
                        break
        want |= {(ord(e[5]), n, "ACLContainsDeny") for e in entries if e[1] in (1, 6)}
    objects = spark.createDataFrame(rows, f"node_id long, type string, descriptor {access.DESCRIPTOR}, class_guids array<string>")
    who = spark.createDataFrame([(ord(s), s) for s in "xyz"], "node_id long, sid string")
    assert pairs(access.access_edges(objects, who)) == want and len(want) > 100
    one = objects.select("node_id", F.explode(access.allowed_sids(F.col("descriptor.dacl"), access.MASKS["WRITE_DACL"], None, F.col("class_guids"))).alias("s")).collect()
    assert {(ord(r["s"]), r["node_id"], "WriteDACL") for r in one} == {e for e in want if e[2] == "WriteDACL"}


def test_conditions(spark):
    """The byte code of conditional entries in infix form; what is no single expression has none."""
    name = lambda t, code=0xF8: bytes([code]) + struct.pack("<I", 2 * len(t)) + t.encode("utf-16-le")
    text = lambda t: name(t, 0x10)
    number = lambda n: b"\x04" + struct.pack("<q", n) + b"\x01\x02"
    counted = lambda code, raw: bytes([code]) + struct.pack("<I", len(raw)) + raw
    sid = counted(0x51, sid_bytes("S-1-5-32-544"))
    cases = [
        (name("Level") + number(-3) + b"\x83", "(Level >= -3)"),
        (name("Title", 0xFB) + text('a"b\n') + b"\x80\0\0", '(Title == "a\\"b\\n")'),
        (name("d") + b"\x8a", "Exists(d)"),
        (name("g") + counted(0x50, sid + text("é")) + b"\x88", '(g Member_of {SID(S-1-5-32-544),"é"})'),
        (name("g") + counted(0x50, number(1)) + b"\x86", "(g Any_of {0x0401000000000000000102})"),
        (counted(0x18, b"\x01\xff") + sid + b"\x81", "(#01FF != SID(S-1-5-32-544))"),
        (b"\xa0", "OP(0xA0)"),
    ]
    for raw, want in cases:
        assert access.condition_text(b"artx" + raw) == want
    for wrong in (b"", b"abcd" + cases[0][0], b"artx", b"artx" + name("a") + name("b"), b"artx\x80", b"artx" + name("abc")[:-2], b"artx\x10\x03\0\0\0abc", b"artx\x51\x02\0\0\0ab", b"artx\x04\0"):
        with pytest.raises(access.Malformed):
            access.condition_text(wrong)
    body = struct.pack("<I", 0x40000) + sid_bytes(A) + b"artx" + cases[0][0]
    raw = descriptor(C, [struct.pack("<BBH", 9, 0, 4 + len(body)) + body, ace(0, 0, 0x100, B)])
    df = objects_of(spark, [(10, "User", raw, [])])
    first, second = df.select("descriptor.dacl").first()[0]
    assert (first["type"], first["sid"], first["condition"]) == (9, A, "(Level >= -3)") and (second["sid"], second["condition"]) == (B, None)
    who = spark.createDataFrame([(1, A)], "node_id long, sid string")
    assert pairs(access.access_edges(df, who)) == {(1, 10, "WriteDACL")}


def test_service_ids_and_escaped_names(spark):
    known = {"msiserver": "S-1-5-80-685333868-2237257676-1431965530-1907094206-2438021966"}
    assert dict(tuple(r) for r in spark.createDataFrame([(n,) for n in known], "n string").select("n", names.service_sid(F.col("n"))).collect()) == known
    rows = [("CN=a\\\\,DC=x", "DC=x", "DC=x"), ("CN=a\\,b,DC=x", "DC=x", "DC=x"), ("CN=a", None, ""), ("DC=x,DC=y", "DC=y", "DC=x,DC=y"), ("CN=a\\\\\\,b,OU=c, dc=y", "OU=c, dc=y", "dc=y")]
    df = spark.createDataFrame([(r[0],) for r in rows], "dn string").select("dn", names.dn_parent(F.col("dn")), names.dn_domain(F.col("dn")))
    assert [tuple(r) for r in df.collect()] == rows


def test_pairs_of_a_common_key_are_dealt_to_cells(spark, monkeypatch):
    """A key that most nodes share is spread over cells; nodes with several keys in common are one pair; null is no key."""
    monkeypatch.setattr(merge, "BLOCK_NODES", 7)
    rows = [(i, "common") for i in range(60)] + [(i, f"k{i % 5}") for i in range(0, 60, 2)] + [(99, None), (98, None)]
    got = [(r["a"], r["b"]) for r in merge.collision_pairs(spark.createDataFrame(rows, "node_id long, k string"), "k").collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
