"""Path patterns as plain descriptions; operators.paths turns them into DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column

MODES = ("WALK", "TRAIL", "ACYCLIC", "SIMPLE")
#: Orders in which the paths of a start may be taken: by hops, or by accumulated probability and then hops.
TRAVERSALS = ("shortest", "likely", "longest", "unlikely")


#: Tags of edge types: fixed values. Types without an entry have none.
EDGE_TAGS = {
    "Pivot": (
        "AddMember", "AddMemberGroupAttr", "AddSelfMember", "AdminRights", "AffectedByGPO", "AutoAdminLogonCreds", "CreateService", "DCOMRights", "DontReqPreauth",
        "ExposesPassword", "FileModifyDACL", "FileTakeOwnership", "HasSPN", "MachineScript", "Owns", "PartOfGPO", "RDPRights", "ReadGMSAPassword", "ReadLAPSPassword",
        "ResetPassword", "SIDHistoryEquality", "SchedTaskOnUNCPath", "SeAssignPrimaryToken", "SeCreateToken", "SeDebug", "SeImpersonate", "SeLoadDriver",
        "SeManageVolume", "SeTakeOwnership", "SeTcb", "SeTrustedCredManAccess", "Session", "SessionBatch", "SessionLocal", "SessionNetwork", "SessionNetworkKerberos",
        "SessionNetworkNTLM", "SessionNetworkNTLMV2", "SessionNetworkNegotiate", "SessionNetworkPlaintext", "SessionRDP", "SessionService", "SvcAccntCreds",
        "TakeOwnership", "WriteAllowedToAct", "WriteAllowedToDelegTo", "WriteAltSecIdent", "WriteDACL", "WriteKeyCredentialLink", "WriteProfilePath", "WriteSPN",
        "WriteScriptPath", "WriteUserAccountControl", "WriteValidatedSPN",
    ),
    "Granted": (
        "AdminRights", "AffectedByGPO", "CertificateAutoEnroll", "CertificateEnroll", "DCOMRights", "DSReplGetChngs", "DSReplGetChngsAll", "DSReplGetChngsInFiltSet",
        "DSReplSync", "HasMSA", "MemberOfGroup", "MemberOfGroupIndirect", "PartOfGPO", "RDPRights", "ReadLAPSPassword", "SMSAdmins",
    ),
    "Informative": ("ACLContainsDeny", "AllExtendedRights", "GenericAll", "Publishes", "SIDCollision", "WriteAll", "WriteExtendedAll", "WritePropertyAll"),
    "Affects": ("ControlsUpdates",),
    "Internal": ("VoodooBit",),
}


def tagged(tag: str) -> tuple[str, ...]:
    """The edge types with a tag, for Edge(types=tagged("Pivot")): a step needs one of them at least."""
    return EDGE_TAGS[tag]


@dataclass(frozen=True)
class Node:
    """Nodes that satisfy `where` (all without it); ordered, skipped and limited before the search starts."""

    where: Column | None = None
    label: str | None = None
    order_by: Column | None = None
    descending: bool = False
    skip: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Edge:
    """Between min_hops and max_hops steps. types: the edge types that count (all without any); negate: none of them may
    be there. match: (comparison, number) of the listed types that a pair must have. probability: (comparison, number)
    on the largest probability of the matched types. through: a predicate on intermediate nodes."""

    types: tuple[str, ...] = ()
    direction: str = "out"
    min_hops: int = 1
    max_hops: int = 1
    negate: bool = False
    match: tuple[str, int] = (">=", 1)
    probability: tuple[str, int] = (">=", 1)
    through: Column | None = None

    def __post_init__(self):
        if not 0 <= self.min_hops <= self.max_hops <= 255 or self.max_hops == 0:
            raise ValueError("hops must be 0 <= min <= max, 1 <= max <= 255")


@dataclass(frozen=True)
class Pattern:
    """Node, edge, node, edge, ..., node. dedup "level" drops, among paths that grow longer, those that enter a node which a
    shorter completed path of the same start holds; "none" keeps all node-unique paths (ACYCLIC only).

    traversal: the order in which the paths of each start are taken up, one at a time, see paths.best_first(). An ACYCLIC
    path is then not lengthened to a node that a path completed before holds. node_limit: a start is given up when its
    completed paths hold so many nodes.

    layered: said of a pattern whose positions' nodes are of different kinds, so that no walk of it can repeat a node: match()
    then counts its paths as it counts walks, and does not list them."""

    parts: tuple[Node | Edge, ...]
    mode: str = "ACYCLIC"
    dedup: str = "none"
    max_depth: int = 255
    min_accumulated: float = 0.0  # product of the steps' probabilities, 0 to 1
    traversal: str | None = None
    node_limit: int | None = None
    layered: bool = False

    nodes: list[Node] = field(init=False, repr=False, compare=False)
    edges: list[Edge] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.traversal is not None and (self.traversal not in TRAVERSALS or self.mode == "WALK"):
            raise ValueError(f"traversal must be one of {TRAVERSALS}, and walks are counted, not taken one by one")
        if self.node_limit is not None and (self.traversal is None or self.node_limit < 1):
            raise ValueError("node_limit is a positive number and needs a traversal")
        if self.layered and (self.traversal is not None or self.dedup != "none" or any(e.max_hops > 1 for e in self.parts[1::2])):
            raise ValueError("a layered pattern has single steps, no traversal and no dedup")
        if len(self.parts) % 2 == 0 or any(isinstance(p, Node) != (i % 2 == 0) for i, p in enumerate(self.parts)):
            raise ValueError("a pattern is node, edge, node, ..., node")
        object.__setattr__(self, "nodes", list(self.parts[::2]))
        object.__setattr__(self, "edges", list(self.parts[1::2]))
