"""The ready-made questions about a directory, as patterns, and queries that ask them of the one that the tables make up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import flat, query
from .functions import predicates as p
from .functions.values import with_attribute
from .operators import access, paths, probability, rules
from .operators import graph as g
from .plans.pattern import Edge, Node, Pattern
from .sources import directory as dr
from .store import cut

QUESTIONS: dict[str, Callable[[g.PropertyGraph], tuple[g.PropertyGraph, Pattern]]] = {}

#: Account flags, and the purposes under which a certificate lets its holder log on: fixed values of the formats.
NOT_REQUIRED, CANT_CHANGE, NEVER_EXPIRES, CONTROLLER, DELEGATION, NO_PREAUTH, WORKSTATION, DISABLED = 0x20, 0x40, 0x10000, 0x2000, 0x80000, 0x400000, 0x1000, 0x2
LOGON_PURPOSES = ("1.3.6.1.5.5.7.3.2", "1.3.5.1.5.2.3.4", "1.3.6.1.4.1.311.20.2.2", "2.5.29.37.0")
USER_ACCOUNT = "805306368"
#: Names of groups that suggest power over virtual machines, or over backups.
HYPERVISORS = ("*vcenter*", "*vmware*", "*esxi*", "*vsan*", "*simplivity*")
BACKUPS = ("*backup*", "*veeam*", "*tsm*", "*tivoli storage*", "*rubrik*", "*commvault*")


def tag(name: str) -> Column:
    return F.coalesce(F.array_contains("tags", name), F.lit(False))


def collected() -> Column:
    return p.equals("dataloader", "Active Directory")


def person_or_group() -> Column:
    return p.of_type("User") | p.of_type("Group")


def any_glob(attr: str, *patterns: str) -> Column:
    return p.any_of(*[p.glob(attr, x) for x in patterns])


def asked(start: Column, direction: str, end: Column | None, hops: int = 6, first: Edge | None = None, least: int = 1) -> Pattern:
    """start, one to `hops` edges of any type in one direction (behind an edge of its own, if there is one), end; shortest
    paths first, and no path on through what a path of its start has shown."""
    before = (Node(start, "start"),) if first is None else (Node(start, "start"), first, Node())
    return Pattern((*before, Edge((), direction, least, hops), Node(end, "end")), traversal="shortest")


def question(name: str, start: Callable[[], Column], direction: str, end: Callable[[], Column] | None = person_or_group, **more) -> None:
    QUESTIONS[name] = lambda graph: (graph, asked(start(), direction, end() if end else None, **more))


def of_controllers(name: str, account: Callable[[], Column]) -> None:
    """Who reaches the machines whose account satisfies a predicate."""

    def ask(graph: g.PropertyGraph) -> tuple[g.PropertyGraph, Pattern]:
        accounts = graph.nodes.where(account())
        marked = g.mark_edge(graph.nodes, graph.edges, "asked", ("MachineAccount",), "out", accounts)
        return g.PropertyGraph(marked, graph.edges), asked(p.of_type("Machine") & F.col("asked"), "in", person_or_group())

    QUESTIONS[name] = ask


flags = lambda bits: p.bits_all("useraccountcontrol", bits)
enroll = Edge(("CertificateEnroll",), "in")
question("high_value_targets", lambda: tag("hvt"), "in", lambda: collected() & ((tag("account_enabled") & p.of_type("User")) | p.of_type("Group")))
question("reach_administrators", lambda: collected() & p.of_type("Group") & (p.equals("objectsid", "S-1-5-32-544") | any_glob("objectsid", "S-1-5-21-*-512", "S-1-5-21-*-519")), "in")
question("run_dcsync", lambda: p.equals("name", "DCsync") & p.of_type("CallableService"), "in")
question("unconstrained_delegation", lambda: tag("unconstrained"), "in")
question("no_preauth_reach", lambda: p.equals("samaccounttype", USER_ACCOUNT) & flags(NO_PREAUTH) & tag("account_active"), "out", None)
question("dns_library", lambda: p.glob("distinguishedname", "CN=MicrosoftDNS,CN=System,DC=*"), "in", hops=15)
question("operators_dump", lambda: collected() & (p.equals("objectsid", "S-1-5-32-551") | p.equals("objectsid", "S-1-5-32-549")), "in", None)
question(
    "templates_any_subject",
    lambda: p.of_type("CertificateTemplate") & p.bits_all("mspki-certificate-name-flag", 1) & (p.any_of(*[p.equals("pkiextendedkeyusage", x) for x in LOGON_PURPOSES]) | p.count("pkiextendedkeyusage", "=", 0)),
    "in", first=enroll,
)
question("templates_version_one", lambda: p.of_type("CertificateTemplate") & p.bits_all("mspki-certificate-name-flag", 1) & p.equals("mspki-template-schema-version", "1"), "in", first=enroll, hops=10, least=0)
question("everyone_reach", lambda: collected() & (p.glob("objectsid", "S-1-5-21-*-513") | p.equals("objectsid", "S-1-5-11") | p.equals("objectsid", "S-1-1-0")), "out", None)
question("hypervisor_groups", lambda: collected() & p.of_type("Group") & any_glob("name", *HYPERVISORS), "in", None)
question("backup_groups", lambda: collected() & p.of_type("Group") & any_glob("name", *BACKUPS), "in")
question("change_policies", lambda: collected() & p.of_type("GroupPolicyContainer"), "in")
question("password_not_required_reach", lambda: collected() & p.of_type("User") & flags(NOT_REQUIRED), "out", None)
question("password_cant_change_reach", lambda: p.of_type("User") & flags(CANT_CHANGE), "out", None)
question("password_never_expires_reach", lambda: p.of_type("User") & flags(NEVER_EXPIRES), "out", None)
question("never_set_password_reach", lambda: collected() & p.equals("objectclass", "person") & p.equals("pwdlastset", "0") & (p.equals("logoncount", "0") | ~p.present("logoncount")) & ~flags(DISABLED), "out", None)
question("protected_users_group", lambda: p.of_type("Group") & p.glob("distinguishedname", "CN=Protected Users,*"), "in")
question("roastable_reach", lambda: p.of_type("User") & p.present("serviceprincipalname") & tag("account_active"), "out")
question("roastable_weak_reach", lambda: p.of_type("User") & p.present("serviceprincipalname") & (p.bits_all("msds-supportedencryptiontypes", 4) | ~p.present("msds-supportedencryptiontypes")) & tag("account_active"), "out")
question("large_groups", lambda: p.of_type("Group") & p.count("member", ">", 100), "out", None)
of_controllers("controllers", lambda: p.of_type("Computer") & flags(CONTROLLER))
of_controllers("read_only_controllers", lambda: p.of_type("Computer") & p.equals("primarygroupid", "521"))
question("delegating_computers", lambda: p.of_type("Computer") & flags(DELEGATION) & ~flags(CONTROLLER), "in")
question("constrained_computers", lambda: p.equals("objectcategory", "computer") & p.present("msds-allowedtodelegateto") & ~flags(CONTROLLER), "in")


def old_passwords(graph: g.PropertyGraph, asof: str) -> tuple[g.PropertyGraph, Pattern]:
    """What accounts whose password is more than five years old at asof reach."""
    old = p.equals("objectclass", "person") & ~p.equals("pwdlastset", "0") & p.since("pwdlastset", "<", asof, years=-5) & ~flags(DISABLED)
    return graph, asked(old, "out", None)


def many_groups(graph: g.PropertyGraph, more_than: int = 10) -> tuple[g.PropertyGraph, Pattern]:
    return graph, Pattern((Node(p.of_type("User") & p.count("memberof", ">", more_than)),))


def some_machines(graph: g.PropertyGraph, n: int = 100) -> tuple[g.PropertyGraph, Pattern]:
    """The first n machines with a workstation's account."""
    marked = g.mark_edge(graph.nodes, graph.edges, "asked", ("MachineAccount",), "out", graph.nodes.where(flags(WORKSTATION)))
    return g.PropertyGraph(marked, graph.edges), Pattern((Node(p.of_type("Machine") & F.col("asked"), order_by=F.col("node_id"), limit=n),))


# ---- the directory of the tables ----
_ESTATES: dict[tuple[str, str], g.PropertyGraph] = {}


def estate(spark: SparkSession, d: str) -> g.PropertyGraph:
    """The directory with its built-in groups, machines and tags, and the edges that the rules and the access lists give. It is
    written once a session and folder of tables; several questions are asked of it."""
    key = spark.sparkContext.applicationId, d
    if key not in _ESTATES:
        _ESTATES[key] = _estate(spark, d)
    return _ESTATES[key]


def _estate(spark: SparkSession, d: str) -> g.PropertyGraph:
    # each map of attributes is written before what reads it several times, which would make it anew each time
    plain = cut(dr.directory(spark, d).unionByName(dr.built_in(spark, d)).unionByName(dr.service_accounts(spark, d)), "estate")
    plain = cut(with_attribute(rules.domain_contexts(plain), "dataloader", F.lit("Active Directory")), "estate")
    plain = cut(rules.parents_by_dn(plain), "estate")
    new, machine_edges = rules.machine_accounts(plain, dr.MACHINE)
    nodes = cut(rules.controller_tags(rules.account_tags(plain, "2024-01-01").unionByName(new)), "estate")
    granted = access.access_edges(dr.access_lists(spark, d), dr.principals(spark, d), schema=dr.attribute_sets(spark, d))
    on_hosts = access.access_edges(dr.host_lists(spark, d), dr.service_principals(spark, d))
    made = [rules.memberships(nodes), rules.broad_memberships(nodes), rules.controller_rights(nodes), rules.policy_links(nodes), machine_edges, rules.update_servers(nodes), granted, on_hosts]
    edges = made[0]
    for more in made[1:]:
        edges = edges.unionByName(more.select(*edges.columns))
    return g.PropertyGraph(nodes, cut(probability.rated(edges, nodes), "estate-edges"))


def answer(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(src, dst, edge_types, flow) of the paths that a question finds."""
    return flat(paths.match(*QUESTIONS[name](estate(spark, d))).edges)


def _ask(name: str):
    def run(spark, d):
        return answer(spark, d, name)

    run.__name__ = f"ask_{name}"
    return run


#: Questions that the tables' directory has answers to.
for _name in ("high_value_targets", "reach_administrators", "run_dcsync", "unconstrained_delegation", "no_preauth_reach", "password_never_expires_reach", "roastable_reach", "controllers", "delegating_computers"):
    query()(_ask(_name))


def _ordered(traversal: str, node_limit: int | None = None) -> Pattern:
    """From accounts without preauthentication, four steps at most, to accounts and groups."""
    start = p.equals("samaccounttype", USER_ACCOUNT) & flags(NO_PREAUTH) & tag("account_active")
    return Pattern((Node(start), Edge((), "out", 1, 4), Node(person_or_group())), traversal=traversal, node_limit=node_limit)


def _paths_by_start(graph: g.PropertyGraph, pattern: Pattern) -> DataFrame:
    """(start, paths, nodes, hops): of each start, how many paths there are, the nodes they hold and the hops they take."""
    return paths.path_counts(graph, pattern)


@query()
def paths_shortest(spark, d):
    return _paths_by_start(estate(spark, d), _ordered("shortest"))


@query()
def paths_likely(spark, d):
    return _paths_by_start(estate(spark, d), _ordered("likely"))


@query()
def paths_node_limit(spark, d):
    return _paths_by_start(estate(spark, d), _ordered("shortest", 5))
