"""Registered queries over the directory that the tables make up: access lists, edge rules, names, merging, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import EDGE_SQL, K, flat, query
from .functions import names
from .functions import predicates as p
from .functions.values import attributes
from .operators import access, merge, paths, probability, rules
from .operators import graph as g
from .plans.pattern import Edge, Node, Pattern, tagged
from .sources import directory as dr
from .sources.tables import edges, nodes, table
from .store import cut

PEOPLE = "(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
HOSTS = "(SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SEGMENTS = f"(SELECT unnest({list(dr.SEGMENTS)}) AS segment, unnest(range({len(dr.SEGMENTS)})) AS g)"


def _text(attr: str):
    return F.col("attrs")[attr][0]["s"]


# ---- access lists ----
#: What an entry must allow for each edge: bits, object types besides none, and the types of objects that it is asked of.
_RIGHTS_SQL = """
    ('GenericAll', 983551, [], []), ('WriteAll', 131112, [], []), ('WritePropertyAll', 32, [], []), ('WriteExtendedAll', 8, [], []), ('TakeOwnership', 524288, [], []),
    ('WriteDACL', 262144, [], []), ('AllExtendedRights', 256, [], []), ('VoodooBit', 4096, [], []),
    ('ResetPassword', 256, ['00299570-246d-11d0-a768-00aa006e0529'], ['User', 'Computer']),
    ('WriteSPN', 32, ['f3a64788-5306-11d1-a9c5-0000f80367c1'], ['User']),
    ('WriteValidatedSPN', 8, ['f3a64788-5306-11d1-a9c5-0000f80367c1'], ['User']),
    ('WriteAllowedToAct', 32, ['3f78c3e5-f79a-46bd-a0b8-9d18116ddc79'], ['User', 'Computer']),
    ('AddMember', 32, ['bf9679c0-0de6-11d0-a285-00aa003049e2'], ['Group']),
    ('AddMemberGroupAttr', 32, ['bc0ac240-79a9-11d0-9020-00c04fc2d4cf'], ['Group']),
    ('AddSelfMember', 8, ['bf9679c0-0de6-11d0-a285-00aa003049e2'], ['Group']),
    ('WriteKeyCredentialLink', 32, ['5b47d60f-6090-40b2-9f37-2a4de88f3063'], ['User', 'Computer']),
    ('WriteUserAccountControl', 32, ['bf967a68-0de6-11d0-a285-00aa003049e2'], ['User']),
    ('WriteAltSecIdent', 32, ['00fbf30c-91fe-11d1-aebc-0000f80367c1', 'e48d0154-bcf8-11d1-8702-00c04fb96050'], ['User']),
    ('WriteProfilePath', 32, ['bf967a05-0de6-11d0-a285-00aa003049e2'], ['User']),
    ('WriteScriptPath', 32, ['bf9679a8-0de6-11d0-a285-00aa003049e2'], ['User']),
    ('WriteAttrSecurityGUID', 32, ['bf967924-0de6-11d0-a285-00aa003049e2'], ['AttributeSchema']),
    ('ReadPasswordId', 16, ['0e78295a-c6d3-0a40-b491-d62251ffa0a6'], ['GroupManagedServiceAccount']),
    ('CertificateEnroll', 256, ['0e10c968-78fb-11d2-90d4-00c04f79dc55'], ['CertificateTemplate']), ('CertificateEnroll', 4096, [], ['CertificateTemplate']),
    ('CertificateAutoEnroll', 256, ['a05b8cc2-17bc-4802-a710-e7c15ab866a2'], ['CertificateTemplate']), ('CertificateAutoEnroll', 4096, [], ['CertificateTemplate']),
    ('DSReplGetChngs', 256, ['1131f6aa-9c07-11d1-f79f-00c04fc2dcd2'], ['DomainDNS']),
    ('DSReplGetChngsAll', 256, ['1131f6ad-9c07-11d1-f79f-00c04fc2dcd2'], ['DomainDNS']),
    ('DSReplGetChngsInFiltSet', 256, ['89e95b76-444d-4c62-991a-0facbeda640c'], ['DomainDNS']),
    ('DSReplSync', 256, ['1131f6ab-9c07-11d1-f79f-00c04fc2dcd2'], ['DomainDNS'])"""
_ENTRIES = f"""ace AS (
        SELECT o_custkey AS obj, o_orderkey AS ord, o_orderstatus = 'P' AS deny, o_orderkey % 11 = 0 AS off,
            list_extract({list(dr.ENTRY_MASKS)}, CAST(o_orderkey % {len(dr.ENTRY_MASKS)} + 1 AS INTEGER)) AS mask, o_custkey - 1 - o_orderkey % 3 AS sid,
            CASE o_orderkey % 3 WHEN 1 THEN list_extract({list(dr.ENTRY_ABOUT)}, CAST(o_orderkey // 3 % {len(dr.ENTRY_ABOUT)} + 1 AS INTEGER)) WHEN 2 THEN 'e48d0154-bcf8-11d1-8702-00c04fb96050' END AS kind,
            coalesce(list_extract({list(dr.LIST_TYPES)}, CAST(o_custkey % 10 + 1 AS INTEGER)), 'User') AS type FROM orders),
    asked(edge_type, need, guids, types, r) AS (SELECT *, row_number() OVER () FROM (VALUES {_RIGHTS_SQL})),
    fits AS (SELECT a.*, edge_type, r FROM ace a JOIN asked ON (a.mask & need) = need AND NOT off AND (kind IS NULL OR list_contains(guids, kind)) AND (len(types) = 0 OR list_contains(types, a.type))),
    granted AS (SELECT DISTINCT sid, obj, edge_type FROM fits a WHERE NOT deny AND NOT EXISTS (SELECT 1 FROM fits d WHERE d.deny AND d.obj = a.obj AND d.sid = a.sid AND d.r = a.r AND d.ord < a.ord))"""


def _access(spark, d) -> DataFrame:
    return access.access_edges(dr.access_lists(spark, d), dr.principals(spark, d), schema=dr.attribute_sets(spark, d))


@query(f"""WITH {_ENTRIES}, found AS (SELECT * FROM granted UNION SELECT sid, obj, 'ACLContainsDeny' FROM ace WHERE deny UNION SELECT o_custkey // 2, o_custkey, 'Owns' FROM orders)
    SELECT 3*{K}+sid AS src, 3*{K}+obj AS dst, edge_type FROM found WHERE sid >= 0 AND sid <> obj""")  # fmt: skip
def acl_edges(spark, d):
    """All rights, by right, attribute or attribute set, unless an earlier entry denies the same id; owners, and denials."""
    return _access(spark, d).select("src", "dst", "edge_type")


@query(f"WITH {_ENTRIES} SELECT 3*{K}+sid AS src, 3*{K}+obj AS dst FROM granted WHERE sid >= 0 AND edge_type IN ('DSReplGetChngs', 'DSReplGetChngsAll') GROUP BY sid, obj HAVING count(DISTINCT edge_type) = 2")
def sync_rights(spark, d):
    return access.sync_rights(_access(spark, d)).select("src", "dst")


@query(f"WITH {_ENTRIES} SELECT 3*{K}+sid AS src, 3*{K}+obj AS dst FROM (SELECT DISTINCT sid, obj FROM ace WHERE NOT deny AND kind IS NULL AND type = 'User') WHERE sid >= 0")
def descriptor_grants(spark, d):
    """Whom plain allow entries name, whatever their mask: delegation to accounts by an attribute that holds a list."""
    return access.descriptor_grants(dr.access_lists(spark, d), dr.principals(spark, d), "descriptor", "RBConstrainedDeleg", ("User",)).select("src", "dst")


# ---- memberships ----
_DIRECT = f"""direct AS (SELECT 3*{K}+c_custkey AS src, {dr.GROUP}+r_regionkey*100+g AS dst, r_regionkey AS r, g FROM {PEOPLE} JOIN {SEGMENTS} ON c_mktsegment = segment
    UNION ALL SELECT {dr.GROUP}+r_regionkey*100+g, {dr.GROUP}+r_regionkey*100+g-1, r_regionkey, g-1 FROM region, {SEGMENTS} WHERE g > 0)"""  # fmt: skip


@query(f"WITH {_DIRECT} SELECT src, dst FROM direct")
def memberships(spark, d):
    return rules.memberships(dr.directory(spark, d)).select("src", "dst")


@query(f"WITH {_DIRECT} SELECT DISTINCT src, {dr.GROUP}+r*100+h AS dst FROM direct, (SELECT unnest(range({len(dr.SEGMENTS)})) AS h) WHERE h < g")
def indirect_memberships(spark, d):
    n = dr.directory(spark, d)
    return rules.indirect_memberships(cut(rules.memberships(n), "members"), n.where("type = 'Group'")).select("src", "dst")


@query(f"SELECT {dr.SERVICE}+r_regionkey AS src, 3*{K}+c_custkey AS dst FROM {PEOPLE} UNION ALL SELECT {dr.SERVICE}+r_regionkey, {dr.GROUP}+r_regionkey*100+g FROM region, {SEGMENTS}")
def overwritten_lists(spark, d):
    n = dr.directory(spark, d)
    return rules.overwritten_lists(n, cut(rules.memberships(n), "members")).select("src", "dst")


@query(f"SELECT 3*{K}+c_custkey AS node_id FROM customer WHERE c_mktsegment <> '{dr.SEGMENTS[0]}'")
def protected_users(spark, d):
    n = dr.directory(spark, d)
    return rules.protected_users(n, cut(rules.memberships(n), "members"))


# ---- policies, accounts, machines ----
def _with_machines(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with a machine for each computer account, and (machine, account)."""
    n = cut(n, "nodes")
    new, links = rules.machine_accounts(n, dr.MACHINE)
    return n.unionByName(new), links.where("edge_type = 'MachineAccount'").select(F.col("src").alias("machine"), F.col("dst").alias("account"))


@query(f"""SELECT {dr.POLICY}+n_nationkey AS src, 4*{K}+s_suppkey AS account FROM {HOSTS} WHERE n_nationkey % 3 <> 0
    UNION ALL SELECT {dr.PLAIN}+r_regionkey, 4*{K}+s_suppkey FROM {HOSTS} WHERE n_nationkey % 4 <> 1
    UNION ALL SELECT {dr.ENFORCED}+r_regionkey, 4*{K}+s_suppkey FROM {HOSTS}""")  # fmt: skip
def policy_links(spark, d):
    """Links of units and domains, disabled, plain and enforced, over units that block inheritance."""
    n, of = _with_machines(rules.parents_by_dn(dr.directory(spark, d)))
    return rules.policy_links(n).join(of, F.col("dst") == F.col("machine")).select("src", "account")


@query(f"""WITH c AS (SELECT 4*{K}+s_suppkey AS account, r_regionkey AS r FROM {HOSTS} WHERE s_suppkey % 10 = 0)
    SELECT {dr.BUILT_IN}+r*100+i AS src, account AS dst, kind AS edge_type FROM c, (VALUES (0, 'AdminRights'), (1, 'RDPRights'), (2, 'DCOMRights')) v(i, kind)
    UNION ALL SELECT account, {dr.BUILT_IN}+r*100+3, 'MemberOfGroup' FROM c UNION ALL SELECT account, {dr.SYNC}, 'Call' FROM c""")  # fmt: skip
def controller_rights(spark, d):
    """Edges of domain controllers; their machines are told by their accounts."""
    n, of = _with_machines(rules.domain_contexts(dr.directory(spark, d)).unionByName(dr.built_in(spark, d)))
    joined = rules.controller_rights(n).join(of, F.col("dst") == F.col("machine"), "left")
    return joined.select("src", F.coalesce("account", "dst").alias("dst"), "edge_type")


@query(f"SELECT 4*{K}+s_suppkey AS account, CASE WHEN s_suppkey % 10 = 0 THEN 'hvt,role_domaincontroller' ELSE '' END AS tags FROM supplier")
def controller_tags(spark, d):
    n, of = _with_machines(dr.directory(spark, d))
    return rules.controller_tags(n).join(of, F.col("node_id") == F.col("machine")).select("account", F.array_join("tags", ",").alias("tags"))


@query(f"""SELECT 3*{K}+c_custkey AS src, {dr.BUILT_IN}+r_regionkey*100+4 AS dst FROM {PEOPLE} UNION ALL SELECT 4*{K}+s_suppkey, {dr.BUILT_IN}+r_regionkey*100+4 FROM {HOSTS}
    UNION ALL SELECT {dr.BUILT_IN}+r_regionkey*100+4, {dr.BUILT_IN}+r_regionkey*100+5 FROM region""")  # fmt: skip
def broad_memberships(spark, d):
    """Authenticated Users and Everyone of each domain."""
    return rules.broad_memberships(dr.directory(spark, d).unionByName(dr.built_in(spark, d))).select("src", "dst")


@query("SELECT 7 AS src, 3*1000000000000+c_custkey AS dst, 'HasSPN' AS edge_type FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 7, 3*1000000000000+c_custkey, 'DontReqPreauth' FROM customer WHERE c_custkey % 5 = 0")
def roastable(spark, d):
    return rules.roastable(dr.directory(spark, d), 7).select("src", "dst", "edge_type")


@query(f"SELECT 4*{K}+b.s_suppkey AS src, 4*{K}+a.s_suppkey AS dst FROM {HOSTS} a JOIN {HOSTS} b ON b.s_suppkey = a.s_suppkey // 10 * 10 AND a.r_regionkey = b.r_regionkey WHERE a.s_suppkey <> b.s_suppkey")
def update_servers(spark, d):
    return rules.update_servers(dr.directory(spark, d)).select("src", "dst")


_TAGS_SQL = """list_sort([x FOR x IN [CASE WHEN f & 2 <> 0 THEN 'account_disabled' ELSE 'account_enabled' END, CASE WHEN f & 2 <> 0 THEN 'account_inactive' ELSE 'account_active' END,
    CASE WHEN f & 65536 <> 0 THEN 'password_never_expires' END, CASE WHEN f & 4096 <> 0 THEN 'computer_account' END, CASE WHEN f & 8192 <> 0 THEN 'domaincontroller_account' END,
    CASE WHEN f & 524288 <> 0 THEN 'unconstrained' END, os, laps] IF x IS NOT NULL])"""


@query(f"""WITH a AS (SELECT 3*{K}+c_custkey AS node_id, (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END) + (CASE WHEN c_custkey % 3 = 0 THEN 65536 ELSE 0 END) + (CASE WHEN c_custkey % 5 = 0 THEN 4194304 ELSE 0 END) AS f, NULL AS os, NULL AS laps FROM customer
    UNION ALL SELECT 4*{K}+s_suppkey, (CASE WHEN s_suppkey % 10 = 0 THEN 8192 ELSE 4096 END) + (CASE WHEN s_suppkey % 7 = 0 THEN 524288 ELSE 0 END), CASE WHEN s_suppkey % 3 = 0 THEN 'linux' ELSE 'windows' END, CASE WHEN s_suppkey % 2 = 0 THEN 'laps' END FROM supplier)
    SELECT node_id, array_to_string({_TAGS_SQL}, ',') AS tags FROM a""")  # fmt: skip
def account_tags(spark, d):
    n = dr.directory(spark, d).where("type in ('User', 'Computer')")
    return rules.account_tags(n, "2024-01-01").select("node_id", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT 4*{K}+s_suppkey AS account, 'S-1-5-21-' || (r_regionkey + 100) || '-1-1-' || (s_suppkey + 500000000) AS sid, 'S' || s_suppkey AS name, 2 AS n_edges FROM {HOSTS}")
def machine_accounts(spark, d):
    new, links = rules.machine_accounts(dr.directory(spark, d), dr.MACHINE)
    n = links.groupBy(F.col("src").alias("node_id"), F.col("dst").alias("account")).agg(F.count(F.lit(1)).cast("int").alias("n_edges"))
    return new.join(n, "node_id").select("account", _text("domainjoinedsid").alias("sid"), _text("name").alias("name"), "n_edges")


@query(f"SELECT 3*{K}+c_custkey AS node_id, r_name || '\\U' || c_custkey AS logon FROM {PEOPLE} UNION ALL SELECT 4*{K}+s_suppkey, r_name || '\\S' || s_suppkey || '$' FROM {HOSTS} UNION ALL SELECT {dr.GROUP}+r_regionkey*100+g, r_name || '\\' || segment FROM region, {SEGMENTS}")
def down_level_names(spark, d):
    n = rules.down_level_names(dr.directory(spark, d))
    return n.where(_text("downlevellogonname").isNotNull()).select("node_id", _text("downlevellogonname").alias("logon"))


@query("SELECT 'DC=' || r_name || ',DC=example' AS context, r_name AS netbios, lower(r_name) || '.example' AS dns, 'S-1-5-21-' || (r_regionkey + 100) || '-1-1' AS sid FROM region")
def domains(spark, d):
    return rules.domains(dr.directory(spark, d))


@query(f"SELECT type, context, count(*) AS n FROM (SELECT 'User' AS type, 'DC=' || r_name || ',DC=example' AS context FROM {PEOPLE} UNION ALL SELECT 'Computer', 'DC=' || r_name || ',DC=example' FROM {HOSTS} UNION ALL SELECT 'CrossRef', 'DC=example' FROM region) GROUP BY type, context")
def domain_contexts(spark, d):
    n = rules.domain_contexts(dr.directory(spark, d)).where("type in ('User', 'Computer', 'CrossRef')")
    return n.groupBy("type", _text("domaincontext").alias("context")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 2*{K}+n_nationkey AS parent, count(*) AS n FROM (SELECT n_nationkey FROM {PEOPLE} UNION ALL SELECT n_nationkey FROM {HOSTS}) GROUP BY n_nationkey")
def direct_subordinates(spark, d):
    n = rules.parents_by_dn(dr.directory(spark, d)).where("type in ('User', 'Computer')")
    return n.groupBy(F.col("parent_id").alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 4*{K}+a.s_suppkey AS src, 4*{K}+b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def sid_collisions(spark, d):
    made = attributes(objectsid=("string", F.concat(F.lit("S-1-5-21-9-9-"), F.col("s_nationkey"))))
    n = table(spark, d, "supplier").select((F.lit(4 * K) + F.col("s_suppkey")).alias("node_id"), F.lit("Machine").alias("type"), made.alias("attrs"))
    return rules.sid_collisions(n).select("src", "dst")


@query("SELECT s_nationkey AS key, min(s_suppkey) AS first, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def collisions(spark, d):
    return merge.collisions(table(spark, d, "supplier"), "s_nationkey", "s_suppkey")


# ---- probability, tags, limits ----
#: Edge types that the two queries below lay, one after the other, from a node to the customers.
_TYPES = """ACLContainsDeny AddMember AddMemberGroupAttr AddSelfMember AdminRights AffectedByGPO AllExtendedRights AuthenticatesAs AutoAdminLogonCreds Call
    CertificateAutoEnroll CertificateEnroll ConstrainedDeleg ContainsSensitiveData Controls ControlsUpdates CreateService DCOMRights DSReplGetChngs DSReplGetChngsAll
    DSReplGetChngsInFiltSet DSReplSync DirCreate DontReqPreauth Executes ExposesPassword FSPartOfGPO FileCreate FileModifyDACL FileRead FileTakeOwnership FileWrite
    ForeignIdentity GenericAll HasMSA HasSPN Hosts InheritsSecurity MachineAccount MachineScript MemberOfGroup MemberOfGroupIndirect OverwritesACL Owns PartOfGPO
    Publishes RBConstrainedDeleg RDPRights ReadGMSAPassword ReadLAPSPassword ReadPasswordId ReadSensitiveData RegistryModifyDACL RegistryModifyOwner RegistryOwns
    RegistryWrite ResetPassword SIDCollision SIDHistoryEquality SMSAdmins SchedTaskOnUNCPath SeAssignPrimaryToken SeBackupPrivilege SeCreateToken SeDebug SeImpersonate
    SeLoadDriver SeManageVolume SeNetworkLogonRight SeRestorePrivilege SeTakeOwnership SeTakeOwnershipPrivilege SeTcb SeTrustedCredManAccess ServiceModify Session
    SessionBatch SessionLocal SessionNetwork SessionNetworkKerberos SessionNetworkNTLM SessionNetworkNTLMV2 SessionNetworkNegotiate SessionNetworkPlaintext SessionRDP
    SessionService Shares SvcAccntCreds TakeOwnership VoodooBit WriteAll WriteAllowedToAct WriteAllowedToDelegTo WriteAltSecIdent WriteAttrSecurityGUID WriteDACL
    WriteExtendedAll WriteKeyCredentialLink WriteProfilePath WritePropertyAll WriteSPN WriteScriptPath WriteUserAccountControl WriteValidatedSPN""".split()


def _typed_edges(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.floor(k / 2) % len(_TYPES) + 1).cast("int"))
    made = F.array_distinct(F.array_compact(F.array(kind, F.when(k % 3 == 0, F.lit("WriteUserAccountControl")))))
    return table(spark, d, "customer").select(F.lit(7).cast("bigint").alias("src"), (F.lit(3 * K) + k).alias("dst"), F.explode(made).alias("edge_type"), F.lit(100).alias("prob"))


_TYPED_SQL = f"""typed AS (SELECT c_custkey AS k, list_extract({_TYPES}, CAST(c_custkey // 2 % {len(_TYPES)} + 1 AS INTEGER)) AS edge_type FROM customer
    UNION SELECT c_custkey, 'WriteUserAccountControl' FROM customer WHERE c_custkey % 3 = 0)"""


@query(f"""WITH {_TYPED_SQL}, pairs AS (SELECT *, k % 2 = 1 AS enabled, bool_or(edge_type = 'WriteUserAccountControl') OVER (PARTITION BY k) AS enables FROM typed)
    SELECT 7 AS src, 3*{K}+k AS dst, edge_type, CASE
        WHEN edge_type IN ('ResetPassword', 'WriteAltSecIdent', 'WriteKeyCredentialLink') THEN CASE WHEN enabled OR enables THEN 100 ELSE 0 END
        WHEN edge_type IN ('Session', 'SessionNetworkPlaintext') THEN CASE WHEN enabled OR enables THEN 80 ELSE 0 END
        WHEN edge_type = 'SessionLocal' THEN CASE WHEN enabled OR enables THEN 55 ELSE 0 END
        WHEN edge_type = 'SMSAdmins' THEN CASE WHEN enabled OR enables THEN 50 ELSE 0 END
        WHEN edge_type IN ('RDPRights', 'DCOMRights', 'SessionRDP', 'SessionService', 'SessionBatch', 'SessionNetwork', 'SessionNetworkNTLM') THEN CASE WHEN enabled OR enables THEN 30 ELSE 0 END
        WHEN edge_type IN ('SessionNetworkNTLMV2', 'SessionNetworkKerberos', 'SessionNetworkNegotiate') THEN CASE WHEN enabled OR enables THEN 20 ELSE 0 END
        WHEN edge_type IN ('HasSPN', 'DontReqPreauth', 'WriteSPN', 'WriteValidatedSPN') THEN CASE WHEN enabled THEN 50 ELSE 0 END
        WHEN edge_type IN ('ACLContainsDeny', 'AllExtendedRights', 'WriteAll', 'WritePropertyAll', 'WriteExtendedAll', 'WriteAttrSecurityGUID', 'SIDCollision') OR edge_type LIKE 'DSRepl%' THEN 0
        WHEN edge_type = 'MachineAccount' THEN -1 WHEN edge_type = 'ReadPasswordId' THEN 5 WHEN edge_type = 'SeNetworkLogonRight' THEN 10 WHEN edge_type = 'SeImpersonate' THEN 20
        WHEN edge_type = 'WriteUserAccountControl' THEN 50 ELSE 100 END AS prob FROM pairs""")  # fmt: skip
def prob_conditional(spark, d):
    """Probabilities of all edge types, which depend on the target's tags and on the pair's other edges."""
    n = rules.account_tags(dr.directory(spark, d).where("type = 'User'"), "2024-01-01")
    return probability.rated(_typed_edges(spark, d), n)


@query(f"""WITH {_TYPED_SQL} SELECT 7 AS src, 3*{K}+k AS dst, count(*) AS n FROM typed WHERE edge_type IN (
        'AddMember', 'AddMemberGroupAttr', 'AddSelfMember', 'AdminRights', 'AffectedByGPO', 'AutoAdminLogonCreds', 'CreateService', 'DCOMRights', 'DontReqPreauth', 'ExposesPassword',
        'FileModifyDACL', 'FileTakeOwnership', 'HasSPN', 'MachineScript', 'Owns', 'PartOfGPO', 'RDPRights', 'ReadGMSAPassword', 'ReadLAPSPassword', 'ResetPassword', 'SIDHistoryEquality',
        'SchedTaskOnUNCPath', 'SvcAccntCreds', 'TakeOwnership') OR edge_type LIKE 'Session%'
        OR (edge_type LIKE 'Se%' AND edge_type NOT IN ('SeBackupPrivilege', 'SeRestorePrivilege', 'SeTakeOwnershipPrivilege', 'SeNetworkLogonRight', 'ServiceModify'))
        OR (edge_type LIKE 'Write%' AND edge_type NOT IN ('WriteAll', 'WritePropertyAll', 'WriteExtendedAll', 'WriteAttrSecurityGUID'))
    GROUP BY k""")  # fmt: skip
def edge_tagged(spark, d):
    """Steps over edges with the tag of those to pivot over, among edges of all types."""
    e = _typed_edges(spark, d)
    n = e.select(F.col("dst").alias("node_id")).union(e.select("src")).distinct()
    found = paths.match(g.PropertyGraph(n, e), Pattern((Node(p.node_id("=", 7)), Edge(tagged("Pivot")), Node()))).edges
    return found.select("src", "dst", F.size("edge_types").cast("long").alias("n"))


@query(f"SELECT src, dst FROM ({EDGE_SQL['InNation']})")
def path_any_type(spark, d):
    """An edge position without types takes edges of all."""
    gr = g.PropertyGraph(nodes(spark, d, "Customer", "Supplier", "Nation"), edges(spark, d, "InNation", "InRegion"))
    return paths.match(gr, Pattern((Node(p.of_type("Customer") | p.of_type("Supplier")), Edge(), Node(p.of_type("Nation"))))).edges.select("src", "dst")


@query(f"SELECT 3*{K}+c_custkey AS src, 2*{K}+c_nationkey AS dst FROM customer UNION ALL SELECT 4*{K}+s_suppkey, 2*{K}+s_nationkey FROM supplier")
def path_max_depth(spark, d):
    """A bound of one step over all positions, where the pattern would allow two."""
    gr = g.PropertyGraph(nodes(spark, d, "Customer", "Supplier", "Nation", "Region"), edges(spark, d, "InNation", "InRegion"))
    pattern = Pattern((Node(p.of_type("Customer") | p.of_type("Supplier")), Edge(max_hops=2), Node()), max_depth=1)
    return paths.match(gr, pattern).edges.select("src", "dst")


@query(f"SELECT 3*{K}+c_custkey AS src, 2*{K}+c_nationkey AS dst FROM customer ORDER BY c_custkey DESC LIMIT 10")
def path_ordered_start(spark, d):
    gr = g.PropertyGraph(nodes(spark, d, "Customer", "Nation"), edges(spark, d, "InNation"))
    start = Node(p.of_type("Customer"), order_by=F.col("node_id"), descending=True, limit=10)
    return flat(paths.match(gr, Pattern((start, Edge(("InNation",)), Node(p.of_type("Nation"))))).edges).select("src", "dst")


@query(f"SELECT 3*{K}+o_custkey AS src, 6*{K}+o_orderkey AS dst, 'Placed' AS edge_type FROM orders WHERE o_orderstatus = 'F'")
def edge_intersection(spark, d):
    e = edges(spark, d, "Placed")
    return g.intersect_pairs(e, e.where("prob = 100"))


@query(f"SELECT 3*{K}+o_custkey AS src, 6*{K}+o_orderkey AS dst, 'Placed' AS edge_type FROM orders WHERE o_orderstatus <> 'F'")
def edge_difference(spark, d):
    e = edges(spark, d, "Placed")
    return g.without_pairs(e, e.where("prob = 100"))


@query(f"SELECT 3*{K}+c_custkey AS src, 3*{K}+c_custkey+1 AS dst FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 3 = 1 OR (c_custkey + 1) % 7 = 0) AND c_custkey + 1 < (SELECT count(*) FROM customer)")
def same_id_edges(spark, d):
    """Edges between nodes of one security id are refused: here of a number and the next where both fall into one third."""
    k = F.col("c_custkey")
    sid = F.when(k % 7 == 0, "S-1-5-10").otherwise(F.concat(F.lit("S-"), F.floor((k + 1) / 3)))
    c = table(spark, d, "customer")
    n = c.select((F.lit(3 * K) + k).alias("node_id"), attributes(objectsid=("string", sid)).alias("attrs"))
    e = c.where(k + 1 < c.count()).select((F.lit(3 * K) + k).alias("src"), (F.lit(3 * K + 1) + k).alias("dst"))
    return g.without_same_id(e, n)


# ---- lookups and names ----
@query(f"SELECT c_name AS key, c_mktsegment AS other_key, 3*{K}+c_custkey AS node_id FROM customer")
def find_two(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("other_key"))
    return g.find_two(nodes(spark, d, "Customer"), wanted, "name", "mktsegment")


@query(f"SELECT 'U' || c_custkey AS key, 3*{K}+c_custkey AS node_id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 's-1-5-21-' || (r_regionkey + 100) || '-1-1-' || (c_custkey + 1000), 3*{K}+c_custkey FROM {PEOPLE} WHERE c_custkey % 2 = 1")
def locate(spark, d):
    """Nodes by whichever of their keys is given: an account name, or a security id."""
    n = dr.directory(spark, d)
    users = n.where("type = 'User'")
    key = F.when(F.col("node_id") % 2 == 0, _text("samaccountname")).otherwise(F.lower(_text("objectsid")))
    return g.locate(n, users.select(key.alias("key")))


@query(f"SELECT 3*{K}+c_custkey AS node_id, 'distinguishedname' AS attr, 'CN=U' || c_custkey || ',OU=' || n_name || ',DC=' || r_name || ',DC=example' AS value, c_name AS label FROM {PEOPLE}")
def primary_ids(spark, d):
    n = dr.directory(spark, d).where("type = 'User'")
    return n.select("node_id", names.primary_id().alias("x"), names.label().alias("label")).select("node_id", "x.attr", "x.value", "label")


@query(f"""SELECT c_custkey AS node_id, c_custkey % 3 <> 0 AS printable, CASE WHEN c_custkey % 3 = 0 THEN c_name || '\\xa' || c_mktsegment ELSE c_name || ' ' || c_mktsegment END AS hex,
    CASE WHEN c_custkey % 2 = 0 THEN 'objectsid' END AS attr, CASE WHEN c_custkey % 5 = 0 THEN '_k=' || c_name ELSE '' END AS meta FROM customer""")  # fmt: skip
def printable_texts(spark, d):
    """Texts with and without a line feed, primary ids, attributes that begin with an underscore."""
    k = F.col("c_custkey")
    text = F.concat("c_name", F.when(k % 3 == 0, "\n").otherwise(" "), "c_mktsegment")
    made = attributes(objectsid=("string", F.when(k % 2 == 0, F.concat(F.lit("S-"), k))), _k=("string", F.when(k % 5 == 0, F.col("c_name"))), other=("string", text))
    n = table(spark, d, "customer").select(k.alias("node_id"), text.alias("t"), made.alias("attrs"))
    meta = F.array_join(F.transform(F.map_entries(names.meta_attributes()), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return n.select("node_id", names.is_printable(F.col("t")).alias("printable"), names.hexified(F.col("t")).alias("hex"), names.primary_id()["attr"].alias("attr"), meta.alias("meta"))


@query("""WITH s AS (SELECT p_partkey AS id, p_size * CASE p_partkey % 5 WHEN 0 THEN 31536000 WHEN 1 THEN 2592000 WHEN 2 THEN 604800 WHEN 3 THEN 86400 ELSE 1800 END AS n FROM part)
    SELECT id, CASE WHEN n % 31536000 = 0 AND n // 31536000 > 1 THEN n // 31536000 || ' years' WHEN n % 2592000 = 0 AND n // 2592000 > 1 THEN n // 2592000 || ' months'
        WHEN n % 604800 = 0 AND n // 604800 > 1 THEN n // 604800 || ' weeks' WHEN n % 86400 = 0 AND n // 86400 > 1 THEN n // 86400 || ' days'
        WHEN n % 3600 = 0 AND n // 3600 > 1 THEN n // 3600 || ' hours' END AS period FROM s""")  # fmt: skip
def pki_periods(spark, d):
    """Sizes of parts as numbers of years, months, weeks, days and half hours."""
    k = F.col("p_partkey") % 5
    span = F.when(k == 0, 31536000).when(k == 1, 2592000).when(k == 2, 604800).when(k == 3, 86400).otherwise(1800)
    seconds = F.col("p_size").cast("bigint") * span
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), names.pki_period(seconds * 10_000_000).alias("period"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS ft, CAST(o_orderdate AS TIMESTAMP) AS gt, o_custkey AS rid,
    'S-1-5-21-' || o_orderkey AS dom, lower(printf('%08X', o_orderkey)) || '-0100-0200-' || lower(printf('%04X', o_custkey % 65536)) || '-000000000003' AS guid FROM orders""")  # fmt: skip
def scalar_formats(spark, d):
    """File times, generalized times, parts of security ids and GUIDs from their bytes, of order dates and keys."""
    o = table(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    ticks = F.when(F.col("o_orderkey") % 9 > 0, (F.unix_timestamp(at) + 11644473600) * 10_000_000).otherwise(0)
    sid = F.concat(F.lit("S-1-5-21-"), "o_orderkey", F.lit("-"), "o_custkey")
    little = F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex("o_orderkey"), 8, "0"), F.lit("(..)"))), "")
    hexed = F.concat(little, F.lit("00010002"), F.lpad(F.hex(F.col("o_custkey") % 65536), 4, "0"), F.lit("000000000003"))
    stamp = F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit(".0Z"))
    return o.select(
        F.col("o_orderkey").alias("id"), names.filetime(ticks).alias("ft"), names.generalized_time(stamp).alias("gt"), names.sid_rid(sid).alias("rid"), names.sid_domain(sid).alias("dom"), names.dotted_guid(hexed).alias("guid"),
    )


@query(f"""SELECT 3*{K}+c_custkey AS node_id, 'OU=b,DC=' || r_name || ',DC=example' AS parent, 'DC=' || r_name || ',DC=example' AS domain,
    CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS commas FROM {PEOPLE}""")  # fmt: skip
def dn_parents(spark, d):
    """Names with escaped commas, escaped backslashes and neither; their parents, domains and first components."""
    people = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    name = F.concat(F.lit("CN="), F.when(k % 3 == 0, "a\\\\").when(k % 3 == 1, "a").otherwise("a\\,b"), F.lit(",OU=b,DC="), "r_name", F.lit(",DC=example"))
    first = F.size(F.split(names.dn_parts(name)[0], ","))
    return people.select((F.lit(3 * K) + k).alias("node_id"), names.dn_parent(name).alias("parent"), names.dn_domain(name).alias("domain"), first.alias("commas"))


# ---- merging ----
def _three_sources(spark, d) -> DataFrame:
    """Customers seen by three sources under one name: as User, as User again (even keys) or Computer (odd), and untyped."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    kind = {0: F.lit("User"), 1: F.when(k % 2 == 0, "User").otherwise("Computer"), 2: F.lit(None).cast("string")}
    part = lambda i: c.select((k * 10 + i).alias("node_id"), kind[i].alias("type"), attributes(name=("string", F.upper("c_name") if i else F.col("c_name")), mail=("string", F.when((k % 5 == 0) & (F.lit(i) < 2), F.lit(f"m{i}")))).alias("attrs"), F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<string>").alias("tags"))
    return part(0).union(part(1)).union(part(2))


@query("SELECT c_custkey * 10 + i AS node_id, CASE WHEN i = 1 AND (c_custkey % 2 = 1 OR c_custkey % 5 = 0) THEN c_custkey * 10 + 1 ELSE c_custkey * 10 END AS into_id FROM customer, (SELECT unnest(range(3)) AS i)")
def merge_conflicts(spark, d):
    """Types that differ, and values of a single attribute that differ, keep entities apart; untyped ones join the first."""
    n = _three_sources(spark, d)
    m = merge.merge_map(n, ("name",), ("mail",))
    return n.join(m, "node_id", "left").select("node_id", F.coalesce("into", "node_id").alias("into_id"))


@query(f"SELECT 3*{K}+c_custkey AS node_id, 2*{K}+c_nationkey AS parent FROM customer UNION ALL SELECT 2*{K}+n_nationkey, 1*{K}+n_regionkey FROM nation UNION ALL SELECT 1*{K}+r_regionkey, 99 FROM region")
def adopt_orphans(spark, d):
    return merge.adopt_orphans(nodes(spark, d, "Customer", "Nation", "Region"), 99).select("node_id", F.col("parent_id").alias("parent"))


@query("SELECT upper(n_name) AS name, 'Nation' AS type FROM nation UNION ALL SELECT 'NATION_' || (n_nationkey + 20), 'Wanted' FROM nation WHERE n_nationkey >= 5")
def find_or_add(spark, d):
    wanted = table(spark, d, "nation").select(F.concat(F.lit("NATION_"), (F.col("n_nationkey") + 20).cast("string")).alias("key"))
    return merge.find_or_add(nodes(spark, d, "Nation"), wanted.union(wanted), "name", "Wanted", 15 * K).select(F.upper(_text("name")).alias("name"), "type")


@query(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 3*{K}+c_custkey ELSE {dr.GROUP}+r_regionkey*100 END AS node_id FROM {PEOPLE}")
def adjacent_ids(spark, d):
    """What a security id means near a node: in a domain the one with it; a built-in id the one of the node's context."""
    n = dr.directory(spark, d)
    built_in = F.when(F.col("node_id") % 100 == 0, F.lit("S-1-5-32-544")).otherwise(_text("objectsid"))
    groups = n.where("type = 'Group'").select("node_id", attributes(objectsid=("string", built_in), domaincontext=("string", _text("domaincontext"))).alias("attrs"))
    users = n.where("type = 'User'").select("node_id", "attrs")
    sid = F.when(F.col("node_id") % 2 == 0, _text("objectsid")).otherwise("S-1-5-32-544")
    asked = users.select((F.col("node_id") - 3 * K).alias("id"), sid.alias("sid"), names.dn_domain(_text("distinguishedname")).alias("context"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("own"))
    return merge.adjacent_ids(groups.union(users), asked).select("id", "node_id")
