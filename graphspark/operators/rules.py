"""Edges from attributes: memberships, policies, delegations, collisions. Each rule reads nodes and gives edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import dn_parent, dn_parts, sid_domain, sid_rid
from ..functions.predicates import values_of
from ..functions.values import VALUE, attributes, with_attribute
from ..store import cut
from .algorithms import reach, reach_states
from .graph import find_one
from .merge import collision_pairs


def _edges(df: DataFrame, edge: str, prob: int = 100) -> DataFrame:
    return df.where("src <> dst").select("src", "dst", F.lit(edge).alias("edge_type"), F.lit(prob).alias("prob")).distinct()


def _first(attr: str):
    return values_of(attr)[0]["s"]


def by_reference(nodes: DataFrame, attr: str, key: str, edge: str, reverse: bool = False) -> DataFrame:
    """An edge to the node whose `key` equals a value of attr: member lists, delegation targets, service accounts, id histories."""
    asked = nodes.select(F.col("node_id").alias("from_id"), F.explode(values_of(attr)).alias("v")).select("from_id", F.col("v.s").alias("key"))
    found = find_one(nodes, asked, key)
    a, b = ("node_id", "from_id") if reverse else ("from_id", "node_id")
    return _edges(found.select(F.col(a).alias("src"), F.col(b).alias("dst")), edge)


def memberships(nodes: DataFrame) -> DataFrame:
    """MemberOfGroup from memberOf of members and member of groups, by distinguished name."""
    return by_reference(nodes, "memberof", "distinguishedname", "MemberOfGroup").union(by_reference(nodes, "member", "distinguishedname", "MemberOfGroup", reverse=True)).distinct()


def indirect_memberships(member_edges: DataFrame, groups: DataFrame) -> DataFrame:
    """MemberOfGroupIndirect: groups that are more than one membership away.

    The closure is taken over groups alone, of which there are far fewer than members; a member's groups are its direct
    ones and what those reach, by one join."""
    inner = member_edges.join(groups.select(F.col("node_id").alias("src")), "src", "left_semi").join(groups.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    above = reach(inner, inner.select(F.col("src").alias("node_id")).distinct()).where("hops > 0")
    far = member_edges.select("src", F.col("dst").alias("seed")).join(above, "seed").select("src", F.col("node_id").alias("dst")).distinct()
    return _edges(far.join(member_edges.select("src", "dst"), ["src", "dst"], "left_anti"), "MemberOfGroupIndirect")


def primary_groups(nodes: DataFrame) -> DataFrame:
    """MemberOfGroup to the group of primaryGroupID in the account's own domain."""
    mine = nodes.select("node_id", sid_domain(_first("objectsid")).alias("domain"), values_of("primarygroupid")[0]["i"].alias("rid")).where("rid is not null")
    groups = nodes.where("type = 'Group'").select(F.col("node_id").alias("dst"), F.lower(_first("objectsid")).alias("sid"))
    asked = mine.select(F.col("node_id").alias("src"), F.lower(F.concat_ws("-", "domain", "rid")).alias("sid"))
    return _edges(asked.join(groups, "sid"), "MemberOfGroup")


#: Options of a link: disabled, and enforced even where inheritance is blocked. Fixed values of the format.
LINK_DISABLED, LINK_ENFORCED = 1, 2


def linked_policies(nodes: DataFrame) -> DataFrame:
    """(container, gpo, enforced) of the links that are not disabled; a gPLink is a list of [LDAP://name;option]."""
    listed = F.regexp_extract_all(F.trim(_first("gplink")), F.lit(r"(?i)\[LDAP://([^;\]]+;\d+)\]"), 1)
    linked = nodes.select(F.col("node_id").alias("container"), F.explode(listed).alias("x"))
    option = F.split_part("x", F.lit(";"), F.lit(2)).cast("int")
    linked = linked.select("container", F.split_part("x", F.lit(";"), F.lit(1)).alias("key"), option.alias("option"))
    live = linked.where(F.col("option").bitwiseAND(F.lit(LINK_DISABLED)) == 0)
    enforced = (F.col("option").bitwiseAND(F.lit(LINK_ENFORCED)) != 0).alias("enforced")
    return find_one(nodes, live, "distinguishedname").select("container", F.col("node_id").alias("gpo"), enforced)


def policy_links(nodes: DataFrame) -> DataFrame:
    """AffectedByGPO from policies to the machines whose account they apply to: those linked to a container above the
    account, and above a container that blocks inheritance (gPOptions 1) only the enforced ones.

    A machine's account is the only node with its domainJoinedSid. The walk upwards carries whether inheritance was blocked; it
    begins at the containers that hold accounts, of which there are far fewer than accounts, and the machines of each come
    in by one join at the end."""
    machines = nodes.where("type = 'Machine'").select(F.col("node_id").alias("machine"), _first("domainjoinedsid").alias("key")).where("key is not null")
    accounts = find_one(nodes, machines, "objectsid").select("machine", "node_id")
    up = nodes.where("parent_id is not null").select(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
    held = cut(accounts.join(up, accounts.node_id == up.src).select("machine", F.col("dst").alias("seed")), "held")
    blocks = nodes.where(_first("gpoptions") == "1").select(F.col("node_id").alias("src"), F.lit(1).alias("blocks"))
    steps = up.join(blocks, "src", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    seeds = held.select(F.col("seed").alias("node_id")).distinct().withColumn("state", F.lit(0))
    above = reach_states(steps, seeds, lambda state: F.greatest(state, F.col("blocks")))
    linked = linked_policies(nodes)
    applied = above.join(linked, above.node_id == linked.container).where("state = 0 or enforced").select("seed", "gpo").distinct()
    return _edges(held.join(applied, "seed").select(F.col("gpo").alias("src"), F.col("machine").alias("dst")), "AffectedByGPO")


def parents_by_dn(nodes: DataFrame) -> DataFrame:
    """nodes with parent_id from the distinguished name, where a node has the parent's name."""
    names = nodes.select("node_id", F.lower(_first("distinguishedname")).alias("dn")).where("dn is not null")
    up = names.select("node_id", dn_parent(F.col("dn")).alias("parent_dn")).join(names.toDF("above", "parent_dn"), "parent_dn").groupBy("node_id").agg(F.min("above").alias("above"))
    return nodes.join(up, "node_id", "left").withColumn("parent_id", F.coalesce("above", "parent_id")).drop("above")


def roastable(nodes: DataFrame, everyone: int) -> DataFrame:
    """HasSPN and DontReqPreauth from authenticated users to accounts: a service name, or bit 22 of the account flags."""
    users = nodes.where("type = 'User'")
    spn = users.where(F.size(values_of("serviceprincipalname")) > 0).select(F.lit(everyone).cast("bigint").alias("src"), F.col("node_id").alias("dst"))
    free = users.where(values_of("useraccountcontrol")[0]["i"].bitwiseAND(F.lit(0x400000)) != 0).select(F.lit(everyone).cast("bigint").alias("src"), F.col("node_id").alias("dst"))
    return _edges(spn, "HasSPN").union(_edges(free, "DontReqPreauth"))


def sid_collisions(nodes: DataFrame) -> DataFrame:
    """SIDCollision between machines of one objectSid."""
    m = nodes.where("type = 'Machine'").select("node_id", F.lower(_first("objectsid")).alias("sid")).where("sid is not null")
    pairs = collision_pairs(m, "sid")  # different nodes, each pair once
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SIDCollision").alias("edge_type"), F.lit(100).alias("prob"))


def update_servers(nodes: DataFrame) -> DataFrame:
    """ControlsUpdates from the machine that a host names as its update server, by DNS name, else by plain name."""
    asked = nodes.select(F.col("node_id").alias("host"), F.explode(F.array_distinct(F.concat(*[F.coalesce(values_of(a), F.array().cast(f"array<{VALUE}>")) for a in ("wuserver", "sccmserver")]))).alias("v"))
    asked = asked.select("host", F.regexp_replace("v.s", r"^\w+://|[:/].*$", "").alias("key"))
    by_dns = find_one(nodes, asked, "dnshostname").select("host", F.col("node_id").alias("server"))
    by_name = find_one(nodes, asked.join(by_dns, "host", "left_anti"), "name").select("host", F.col("node_id").alias("server"))
    return _edges(by_dns.union(by_name).select(F.col("server").alias("src"), F.col("host").alias("dst")), "ControlsUpdates")


# ---- accounts and machines ----
#: (tag, bits of the account flags that must be set, bits that must not be): fixed values of the format.
ACCOUNT_TAGS = [
    ("unconstrained", 0x80000, 0x100000), ("constrained", 0x1000000, 0), ("nodelegation", 0x100000, 0), ("computer_account", 0x1000, 0),
    ("domaincontroller_account", 0x2000, 0), ("account_disabled", 0x2, 0), ("account_enabled", 0, 0x2), ("account_locked", 0x10, 0),
    ("password_cant_change", 0x40, 0), ("password_never_expires", 0x10000, 0), ("password_not_required", 0x20, 0),
]


def account_tags(nodes: DataFrame, asof: str) -> DataFrame:
    """nodes with tags from the account flags, the expiry against asof, the operating system and the password attribute."""
    flags = values_of("useraccountcontrol")[0]["i"]
    has = lambda on, off: (flags.bitwiseAND(F.lit(on)) == on) & (flags.bitwiseAND(F.lit(off)) == 0)
    expired = F.coalesce(values_of("accountexpires")[0]["t"] < F.lit(asof).cast("timestamp"), F.lit(False))
    gone = (flags.bitwiseAND(F.lit(0x2)) != 0) | expired
    system = F.lower(_first("operatingsystem"))
    tests = [(tag, has(on, off)) for tag, on, off in ACCOUNT_TAGS]
    tests += [("account_expired", flags.isNotNull() & expired), ("account_inactive", gone), ("account_active", ~gone), ("linux", system.contains("linux")), ("windows", system.contains("windows"))]
    tests += [("laps", F.size(values_of("ms-mcs-admpwdexpirationtime")) > 0)]
    new = F.array_compact(F.array(*[F.when(test, tag) for tag, test in tests]))
    return nodes.withColumn("tags", F.array_sort(F.array_union("tags", new)))


def account_ages(nodes: DataFrame, asof: str) -> DataFrame:
    """nodes with the whole hours since the password was set and since the last logon, where these times are known."""
    hours = lambda attr: F.floor((F.unix_timestamp(F.lit(asof).cast("timestamp")) - F.unix_timestamp(values_of(attr)[0]["t"])) / 3600)
    ages = attributes(passwordage=("int", hours("pwdlastset")), lastloginage=("int", hours("lastlogontimestamp")))
    rest = F.map_filter("attrs", lambda k, _: ~k.isin("passwordage", "lastloginage"))
    return nodes.withColumn("attrs", F.map_concat(rest, ages))


def machine_accounts(nodes: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """A Machine node for each computer account with a security id (unless a machine has that domainJoinedSid), below the
    account; AuthenticatesAs and MachineAccount edges from the machine."""
    accounts = nodes.where("type = 'Computer'").select("node_id", _first("objectsid").alias("sid"), _first("name").alias("name"), _first("dnshostname").alias("host")).where("sid is not null")
    have = nodes.where("type = 'Machine'").select(F.lower(_first("domainjoinedsid")).alias("low"), F.col("node_id").alias("machine"))
    known = accounts.withColumn("low", F.lower("sid")).join(have, "low", "left")
    hashed = F.xxhash64("low").bitwiseAND(F.lit((1 << 58) - 1)) + F.lit(first_id)
    linked = known.withColumn("is_new", F.col("machine").isNull()).withColumn("machine", F.coalesce("machine", hashed))
    attrs = attributes(domainjoinedsid=("string", F.col("sid")), name=("string", F.col("name")), dnshostname=("string", F.col("host")))
    new = linked.where("is_new").select(F.col("machine").alias("node_id"), F.lit("Machine").alias("type"), attrs.alias("attrs"), F.col("node_id").alias("parent_id"), F.array().cast("array<string>").alias("tags"))
    ends = linked.select(F.col("machine").alias("src"), F.col("node_id").alias("dst"))
    return new, _edges(ends, "AuthenticatesAs").union(_edges(ends, "MachineAccount"))


#: Account flags and relative ids of domain controllers, and what built-in groups may do on them: fixed values.
CONTROLLER, READ_ONLY_CONTROLLERS = 0x2000, 521
ENTERPRISE_CONTROLLERS, AUTHENTICATED, EVERYONE = "S-1-5-9", "S-1-5-11", "S-1-1-0"
CONTROLLER_GROUPS = {"S-1-5-32-544": "AdminRights", "S-1-5-32-555": "RDPRights", "S-1-5-32-562": "DCOMRights"}
SYNC_POINT = "DCsync"


def _machine_of(nodes: DataFrame, accounts: DataFrame) -> DataFrame:
    """accounts (account, sid, ...) with the only machine of that domainJoinedSid."""
    return find_one(nodes.where("type = 'Machine'"), accounts.withColumnRenamed("sid", "key"), "domainjoinedsid").withColumnRenamed("node_id", "machine")


def _controllers(nodes: DataFrame) -> DataFrame:
    flagged = nodes.where(values_of("useraccountcontrol")[0]["i"].bitwiseAND(F.lit(CONTROLLER)) != 0)
    return flagged.select(F.col("node_id").alias("account"), _first("objectsid").alias("sid"), F.lower(_first("domaincontext")).alias("context"))


def controller_rights(nodes: DataFrame) -> DataFrame:
    """What follows from an account being a domain controller: the rights of built-in groups of its domain on its machine, its
    membership in the enterprise's controllers, and Call to the service point of replication (of type CallableService)."""
    found = cut(_controllers(nodes), "controllers")
    groups = nodes.select(F.col("node_id").alias("group"), F.upper(_first("objectsid")).alias("group_sid"), F.lower(_first("domaincontext")).alias("context"))
    groups = groups.where(F.col("group_sid").isin(*CONTROLLER_GROUPS, ENTERPRISE_CONTROLLERS))
    single = cut(groups.groupBy("group_sid", "context").agg(F.min("group").alias("group"), F.count(F.lit(1)).alias("n")).where("n = 1"), "built-in")
    named = F.element_at(F.create_map(*[F.lit(x) for kv in CONTROLLER_GROUPS.items() for x in kv]), F.col("group_sid"))
    on_machine = _machine_of(nodes, found).join(single.where(F.col("group_sid") != ENTERPRISE_CONTROLLERS), "context")
    rights = on_machine.select(F.col("group").alias("src"), F.col("machine").alias("dst"), named.alias("edge_type"))
    enterprise = single.where(F.col("group_sid") == ENTERPRISE_CONTROLLERS).select("context", F.col("group").alias("dst"))
    member = found.join(enterprise, "context").select(F.col("account").alias("src"), "dst", F.lit("MemberOfGroup").alias("edge_type"))
    point = nodes.where((F.col("type") == "CallableService") & (_first("name") == SYNC_POINT)).agg(F.min("node_id").alias("dst")).where("dst is not null")
    call = found.join(F.broadcast(point)).select(F.col("account").alias("src"), "dst", F.lit("Call").alias("edge_type"))  # one row
    return rights.union(member).union(call).where("src <> dst").distinct().withColumn("prob", F.lit(100))


def controller_tags(nodes: DataFrame) -> DataFrame:
    """nodes with role and hvt tags of machines whose account is a domain controller, or in the group of read-only ones."""
    writable = _machine_of(nodes, _controllers(nodes)).select("machine", F.lit("role_domaincontroller").alias("tag"))
    readers = nodes.where(values_of("primarygroupid")[0]["i"] == READ_ONLY_CONTROLLERS).where(values_of("useraccountcontrol").isNotNull())
    readers = readers.select(F.col("node_id").alias("account"), _first("objectsid").alias("sid"))
    readable = _machine_of(nodes, readers).select("machine", F.lit("role_readonly_domaincontroller").alias("tag"))
    new = writable.union(readable).groupBy(F.col("machine").alias("node_id")).agg(F.collect_set("tag").alias("more"))
    joined = nodes.join(new, "node_id", "left")
    all_of = F.array_sort(F.array_union("tags", F.array_append("more", F.lit("hvt"))))
    return joined.withColumn("tags", F.when(F.col("more").isNotNull(), all_of).otherwise(F.col("tags"))).drop("more")


def broad_memberships(nodes: DataFrame) -> DataFrame:
    """MemberOfGroup from a domain's accounts (not groups) to its Authenticated Users, and from those to Everyone; each domain
    has its own node of the two, by domaincontext."""
    low = lambda a: F.lower(_first(a))
    broad = nodes.where(F.upper(_first("objectsid")).isin(AUTHENTICATED, EVERYONE)).select(F.upper(_first("objectsid")).alias("which"), low("domaincontext").alias("context"), "node_id")
    one = broad.groupBy("context").agg(*[F.min(F.when(F.col("which") == sid, F.col("node_id"))).alias(name) for sid, name in ((AUTHENTICATED, "users"), (EVERYONE, "all"))])
    one = cut(one, "broad")
    roots = nodes.where("type = 'DomainDNS'").select(low("objectsid").alias("domain"), low("domaincontext").alias("context"))
    accounts = nodes.where("type <> 'Group'").select("node_id", F.lower(sid_domain(_first("objectsid"))).alias("domain"))
    inside = accounts.join(roots.join(one, "context"), "domain").select(F.col("node_id").alias("src"), F.col("users").alias("dst"))
    return _edges(inside.union(one.select("users", "all")).where("src is not null and dst is not null"), "MemberOfGroup")


def password_readers(granted: DataFrame, machine_edges: DataFrame, managed: DataFrame) -> DataFrame:
    """ReadLAPSPassword to the machines of managed accounts (node_id): whom access_edges() grants the password attributes of
    the account, as edges (src, dst)."""
    of = machine_edges.where("edge_type = 'MachineAccount'").select(F.col("dst").alias("account"), F.col("src").alias("machine"))
    on = granted.select("src", F.col("dst").alias("account")).join(managed.select(F.col("node_id").alias("account")), "account", "left_semi")
    return _edges(on.join(of, "account").select("src", F.col("machine").alias("dst")), "ReadLAPSPassword")


def managed_accounts(nodes: DataFrame) -> DataFrame:
    """(node_id) of computers with an expiry of a managed local password, of either version."""
    managed = F.coalesce(F.size(values_of("ms-mcs-admpwdexpirationtime")) > 0, F.lit(False)) | F.coalesce(F.size(values_of("ms-laps-passwordexpirationtime")) > 0, F.lit(False))
    return nodes.where((F.col("type") == "Computer") & managed).select("node_id")


def inherits_security(objects: DataFrame, nodes: DataFrame) -> DataFrame:
    """InheritsSecurity from the parent (parent_id) to objects (node_id, descriptor) whose list is not protected."""
    open_ones = objects.where(F.col("descriptor.control").bitwiseAND(F.lit(0x1000)) == 0).select("node_id")
    below = nodes.where("parent_id is not null and type <> 'ForeignSecurityPrincipal'").join(open_ones, "node_id")
    return _edges(below.select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst")), "InheritsSecurity")


def policy_parts(nodes: DataFrame) -> DataFrame:
    """PartOfGPO from a policy to the containers Machine and User in it."""
    inner = nodes.where((F.col("type") == "Container") & _first("name").isin("Machine", "User")).select("node_id", "parent_id")
    policies = nodes.where("type = 'GroupPolicyContainer'").select(F.col("node_id").alias("parent_id"))
    return _edges(inner.join(policies, "parent_id").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst")), "PartOfGPO")


def sync_accounts(nodes: DataFrame) -> DataFrame:
    """SessionService from the machine that the description of a synchronisation account (MSOL_...) names."""
    host = F.regexp_extract(_first("description"), r"installation identifier [0-9a-f]+ running on computer ([^ ]+) configured to synchronize", 1)
    asked = nodes.where((F.col("type") == "User") & _first("name").startswith("MSOL_")).select(F.col("node_id").alias("account"), host.alias("key")).where("key <> ''")
    found = find_one(nodes.where("type = 'Machine'"), asked, "name")
    return _edges(found.select(F.col("node_id").alias("src"), F.col("account").alias("dst")), "SessionService")


def constrained_delegation(nodes: DataFrame) -> DataFrame:
    """CD to the machine that a delegation target (service/host) names, of accounts trusted to authenticate for others; a
    plain host name gets the account's domain suffix."""
    from ..functions.names import domain_suffix

    trusted = nodes.where(F.col("type").isin("Computer", "User") & (values_of("useraccountcontrol")[0]["i"].bitwiseAND(F.lit(0x1000000)) != 0))
    listed = trusted.select(F.col("node_id").alias("src"), domain_suffix(_first("domaincontext")).alias("suffix"), F.explode(values_of("msds-allowedtodelegateto")).alias("v"))
    rest = listed.select("src", "suffix", F.regexp_extract("v.s", r"^[^/]*/([^/:]+)(?::[^/]*)?$", 1).alias("host")).where("host <> ''")
    asked = rest.select("src", F.when(F.col("host").contains("."), F.col("host")).otherwise(F.concat_ws(".", "host", "suffix")).alias("key"))
    found = find_one(nodes.where("type = 'Machine'"), asked, "dnshostname")
    return _edges(found.select("src", F.col("node_id").alias("dst")), "CD")


def local_parents(nodes: DataFrame) -> DataFrame:
    """nodes with users and groups of a collected source below the machine of that source whose local id their own begins with."""
    hosts = nodes.where("type = 'Machine'").select(F.lower(_first("datasource")).alias("source"), F.lower(_first("localmachinesid")).alias("domain"), F.col("node_id").alias("host")).where("source is not null and domain is not null")
    single = hosts.groupBy("source", "domain").agg(F.min("host").alias("host"))
    mine = nodes.where("type in ('User', 'Group')").select("node_id", F.lower(_first("datasource")).alias("source"), F.lower(sid_domain(_first("objectsid"))).alias("domain"))
    found = mine.join(single, ["source", "domain"]).select("node_id", "host")
    return nodes.join(found, "node_id", "left").withColumn("parent_id", F.coalesce("host", "parent_id")).drop("host")


def unlinked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id) of nodes with a security id and no edge: broken links."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    return nodes.where(F.size(values_of("objectsid")) > 0).select("node_id").join(ends, "node_id", "left_anti")


# ---- domains ----
def domain_contexts(nodes: DataFrame) -> DataFrame:
    """nodes with domaincontext, where they have none: the run of DC components at the end of the name, without DNS zones."""
    dn = _first("distinguishedname")
    context = F.regexp_extract(dn, r"(?i)(?:^|,)((?:dc=(?!(?:forest|domain)dnszones(?:,|$))[^,]*,?)+)$", 1)
    return with_attribute(nodes, "domaincontext", F.when((context != "") & values_of("domaincontext").isNull(), context))


def down_level_names(nodes: DataFrame) -> DataFrame:
    """nodes with downlevellogonname, NETBIOS name and account name, from the cross reference of the longest naming context
    that the distinguished name ends with. The suffixes of a name's components are joined, not all pairs."""
    cross = nodes.where(F.exists(values_of("objectclass"), lambda v: F.lower(v["s"]) == "crossref")).select(_first("ncname").alias("suffix"), _first("netbiosname").alias("netbios")).where("suffix <> '' and netbios <> ''")
    single = cross.groupBy("suffix").agg(F.min("netbios").alias("netbios"))
    parts = dn_parts(_first("distinguishedname"))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ","))
    named = nodes.where(_first("samaccountname").isNotNull()).select("node_id", F.explode(tails).alias("suffix"))
    best = named.join(single, "suffix").groupBy("node_id").agg(F.max_by("netbios", F.length("suffix")).alias("netbios"))
    joined = nodes.join(best, "node_id", "left")
    name = F.when(_first("samaccountname").isNotNull(), F.concat(F.col("netbios"), F.lit("\\"), _first("samaccountname")))
    return with_attribute(joined, "downlevellogonname", name).drop("netbios")


#: Relative ids of the groups whose members an AdminSDHolder protects, and the bit of the heuristics that excludes one.
PROTECTED = {500: 0, 502: 0, 512: 0, 516: 0, 518: 0, 519: 0, 521: 0, 544: 0, 548: 1, 549: 2, 550: 4, 551: 8, 552: 0}


def overwritten_lists(nodes: DataFrame, member_edges: DataFrame, excluded: int = 0) -> DataFrame:
    """OverwritesACL from a domain's AdminSDHolder to its protected groups and all that are in them, over any number of
    memberships; `excluded` are the heuristics' bits of groups left out."""
    holder = nodes.where(F.lower(_first("distinguishedname")).startswith("cn=adminsdholder,cn=system,")).select(F.col("node_id").alias("holder"), F.lower(_first("domaincontext")).alias("context"))
    wanted = [rid for rid, bit in PROTECTED.items() if not bit & excluded]
    sid = _first("objectsid")
    groups = nodes.where((F.col("type") == "Group") & sid_rid(sid).isin(*wanted) & F.split(sid, "-")[3].isin("21", "32")).select("node_id", F.lower(_first("domaincontext")).alias("context"))
    pairs = groups.join(holder, "context").select("holder", "node_id")
    inside = reach(member_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), groups).select(F.col("seed").alias("node_id"), F.col("node_id").alias("member"))
    return _edges(pairs.join(inside, "node_id").select(F.col("holder").alias("src"), F.col("member").alias("dst")), "OverwritesACL")


def protected_users(nodes: DataFrame, member_edges: DataFrame) -> DataFrame:
    """(node_id) of users and computers in a Protected Users group (relative id 525), over any number of memberships."""
    sid = _first("objectsid")
    groups = nodes.where((sid_rid(sid) == 525) & (F.split(sid, "-")[3] == "21")).select("node_id")
    inside = reach(member_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), groups).where("hops > 0").select("node_id").distinct()
    return inside.join(nodes.where("type in ('User', 'Computer')").select("node_id"), "node_id", "left_semi")


def known_names(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """nodes with displayname of well-known security ids, known (sid, name), where they have none."""
    names = known.select(F.lower("sid").alias("low"), F.col("name").alias("known_name"))
    joined = nodes.withColumn("low", F.lower(_first("objectsid"))).join(F.broadcast(names), "low", "left")
    return with_attribute(joined, "displayname", F.when(values_of("displayname").isNull(), F.col("known_name"))).drop("low", "known_name")


def missing_known(nodes: DataFrame, known: DataFrame, first_id: int) -> DataFrame:
    """Nodes of well-known security ids (sid, name) that no node has; groups by type."""
    have = nodes.select(F.lower(_first("objectsid")).alias("low")).where("low is not null").distinct()
    new = known.withColumn("low", F.lower("sid")).join(have, "low", "left_anti")
    attrs = attributes(objectsid=("string", F.col("sid")), name=("string", F.col("name")), distinguishedname=("string", F.concat(F.lit("CN="), "name", F.lit(",CN=microsoft-builtin"))))
    number = F.xxhash64("low").bitwiseAND(F.lit((1 << 58) - 1)) + F.lit(first_id)
    return new.select(number.alias("node_id"), F.lit("Group").alias("type"), attrs.alias("attrs"), F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<string>").alias("tags"))


def published_templates(nodes: DataFrame) -> DataFrame:
    """(node_id, service, host) of certificate templates and the enrollment services of their domain that offer them."""
    context = F.lower(_first("domaincontext")).alias("context")
    offered = nodes.where("type = 'PKIEnrollmentService'").select(_first("distinguishedname").alias("service"), _first("dnshostname").alias("host"), context, F.explode(values_of("certificatetemplates")).alias("v"))
    asked = offered.select("service", "host", "context", F.lower("v.s").alias("low"))
    templates = nodes.where(F.exists(values_of("objectclass"), lambda v: F.lower(v["s"]) == "pkicertificatetemplate")).select("node_id", context, F.lower(_first("name")).alias("low"))
    return asked.join(templates, ["low", "context"]).select("node_id", "service", "host")


def foreign_identities(nodes: DataFrame) -> DataFrame:
    """ForeignIdentity from the object of a domain to the objects of other domains that carry its security id."""
    domains = nodes.where("type = 'DomainDNS'").select(F.lower(_first("objectsid")).alias("domain"), F.lower(_first("domaincontext")).alias("home")).where("domain is not null")
    low = F.lower(_first("objectsid")).alias("sid")
    held = nodes.select("node_id", low, F.lower(sid_domain(_first("objectsid"))).alias("domain"), F.lower(_first("domaincontext")).alias("context")).where("sid is not null and context is not null")
    away = held.join(domains, "domain").where("context <> home").select(F.col("node_id").alias("dst"), "sid", "home")
    native = held.groupBy("sid", F.col("context").alias("home")).agg(F.min("node_id").alias("src"))
    return _edges(away.join(native, ["sid", "home"]), "ForeignIdentity")


def expanded_groups(gpo_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of groups whose account name holds %computername%, %domainname% or %domain% to a policy, as edges of the group
    meant to each computer that the policy affects."""
    first = lambda a: F.lower(F.col("attrs")[a][0]["s"])
    policies = nodes.where("type = 'GroupPolicyContainer'").select(F.col("node_id").alias("gpo"))
    by_name = gpo_edges.join(nodes.select(F.col("node_id").alias("src"), first("samaccountname").alias("pattern")), "src").where(F.col("pattern").contains("%"))
    to_policy = by_name.select(F.col("dst").alias("gpo"), "pattern", F.col("edge_type").alias("edge")).join(policies, "gpo", "left_semi")
    hosts = nodes.where("type = 'Computer'").select(F.col("node_id").alias("host"), first("downlevellogonname").alias("logon")).where(F.col("logon").contains("\\"))
    affected = gpo_edges.where("edge_type = 'AffectedByGPO'").select(F.col("src").alias("gpo"), F.col("dst").alias("host")).join(hosts, "host")
    netbios, machine = F.split_part("logon", F.lit("\\"), F.lit(1)), F.rtrim(F.split_part("logon", F.lit("\\"), F.lit(2)), F.lit("$"))
    real = F.replace(F.replace(F.replace("pattern", F.lit("%computername%"), machine), F.lit("%domainname%"), netbios), F.lit("%domain%"), netbios)
    asked = to_policy.join(affected, "gpo").select("edge", "host", F.when(real.contains("\\"), real).otherwise(F.concat_ws("\\", netbios, real)).alias("key"))
    found = find_one(nodes, asked, "downlevellogonname")
    return found.select(F.col("node_id").alias("src"), F.col("host").alias("dst"), F.col("edge").alias("edge_type"), F.lit(100).alias("prob")).where("src <> dst").distinct()


def domains(nodes: DataFrame) -> DataFrame:
    """(context, netbios, dns, sid) of each domain: a domain object with a security id and its cross reference."""
    is_a = lambda c: F.exists(values_of("objectclass"), lambda v: F.lower(v["s"]) == c)
    roots = nodes.where(is_a("domaindns")).select(_first("distinguishedname").alias("context"), _first("objectsid").alias("sid")).where("sid is not null")
    cross = nodes.where(is_a("crossref")).select(F.lower(_first("ncname")).alias("low"), _first("netbiosname").alias("netbios"), _first("dnsroot").alias("dns"))
    return roots.withColumn("low", F.lower("context")).join(cross, "low").select("context", "netbios", "dns", "sid")


DIRECTIONS = ("disabled", "incoming", "outgoing", "bidirectional")  # fixed values of the format


def trusts(nodes: DataFrame) -> DataFrame:
    """(source, target, direction, filtered) of trust objects: the DNS names of the domain and its partner; filtered is false
    where an outgoing forest trust is treated as external, which lets foreign ids in."""
    rows = nodes.where("type = 'Trust'").select(F.lower(_first("domaincontext")).alias("low"), _first("trustpartner").alias("target"), values_of("trustdirection")[0]["i"].alias("d"), values_of("trustattributes")[0]["i"].alias("a"))
    home = domains(nodes).select(F.lower("context").alias("low"), F.lower("dns").alias("source"))
    direction = F.element_at(F.array(*[F.lit(x) for x in DIRECTIONS]), (F.coalesce("d", F.lit(0)) + 1).cast("int"))
    bits = lambda c, m: F.coalesce(F.col(c), F.lit(0)).bitwiseAND(F.lit(m)) != 0
    return rows.join(home, "low").select("source", "target", direction.alias("direction"), (~(bits("d", 2) & bits("a", 8) & bits("a", 0x40))).alias("filtered"))


def trust_map(nodes: DataFrame) -> DataFrame:
    """(source, target, incoming, outgoing): one row a pair of domains, from both sides' trust objects."""
    t = trusts(nodes)
    return t.groupBy("source", "target").agg(F.max(F.col("direction").isin("incoming", "bidirectional")).alias("incoming"), F.max(F.col("direction").isin("outgoing", "bidirectional")).alias("outgoing"))


#: Names of types for the schema's names of object categories: fixed values.
TYPE_NAMES = {
    "attribute-schema": "AttributeSchema", "builtin-domain": "BuiltinDomain", "callable-service-point": "CallableService", "certification-authority": "CertificationAuthority",
    "class-schema": "ClassSchema", "computer": "Computer", "container": "Container", "control-access-right": "ControlAccessRight", "dns-node": "DNSNode", "dns-zone": "DNSZone",
    "domain-dns": "DomainDNS", "foreign-security-principal": "ForeignSecurityPrincipal", "group": "Group", "group-policy-container": "GroupPolicyContainer",
    "ms-ds-group-managed-service-account": "GroupManagedServiceAccount", "ms-ds-managed-service-account": "ManagedServiceAccount", "organizational-unit": "OrganizationalUnit",
    "person": "User", "pki-certificate-template": "CertificateTemplate", "pki-enrollment-service": "PKIEnrollmentService", "trusted-domain": "Trust",
}


def schema_types(nodes: DataFrame) -> DataFrame:
    """nodes with type from the schema object that objectCategory names (by distinguished name): its name, in this library's
    spelling where it has one. A category that no schema object has, or none, is "Unknown"."""
    low = F.lower(_first("distinguishedname"))
    schema = nodes.where((F.size(values_of("schemaidguid")) > 0) & low.isNotNull()).groupBy(low.alias("category")).agg(F.min(_first("name")).alias("simple"))
    joined = nodes.withColumn("category", F.lower(_first("objectcategory"))).join(schema, "category", "left")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv]), F.lower("simple"))
    return joined.withColumn("type", F.coalesce(known, "simple", F.lit("Unknown"))).drop("category", "simple")


def class_guids(nodes: DataFrame) -> DataFrame:
    """(node_id, class_guids): the schema ids of a node's classes, found by the classes' display names."""
    schema = nodes.select(F.lower(_first("ldapdisplayname")).alias("low"), F.lower(_first("schemaidguid")).alias("guid")).where("low is not null and guid is not null")
    single = schema.groupBy("low").agg(F.min("guid").alias("guid"))
    asked = nodes.select("node_id", F.explode(values_of("objectclass")).alias("v")).select("node_id", F.lower("v.s").alias("low"))
    return asked.join(single, "low").groupBy("node_id").agg(F.array_sort(F.collect_set("guid")).alias("class_guids"))
