"""Evaluation of access-control lists, and edges from who may do what to whom."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACE = "struct<ord:int,type:int,aceflags:int,flags:int,mask:bigint,sid:string,object_type:string,inherited_object_type:string,condition:string>"
DESCRIPTOR = f"struct<control:int,owner:string,grp:string,dacl:array<{ACE}>>"

# Fixed values of the access-control format.
ALLOWED, DENIED, ALLOWED_OBJECT, DENIED_OBJECT, ALLOWED_IF = 0, 1, 5, 6, 9
#: Entries that grant; one with a condition is taken to grant, as who holds may satisfy it.
GRANTS, DENIALS = (ALLOWED, ALLOWED_OBJECT, ALLOWED_IF), (DENIED, DENIED_OBJECT)
DACL_PROTECTED = 0x1000
INHERIT_ONLY, INHERITED = 0x08, 0x10
SELF = "S-1-5-10"  # an object's own id, which always has its rights
NO_GUID = "00000000-0000-0000-0000-000000000000"
MASKS = {
    "GENERIC_ALL": 0x000F01FF, "GENERIC_WRITE": 0x00020028, "WRITE_OWNER": 0x00080000, "WRITE_DACL": 0x00040000,
    "DS_CONTROL_ACCESS": 0x00000100, "DS_WRITE_PROPERTY": 0x00000020, "DS_READ_PROPERTY": 0x00000010, "DS_WRITE_PROPERTY_EXTENDED": 0x00000008,
    "DS_VOODOO_BIT": 0x00001000,
}
#: (edge, node types or none for all, mask, GUID of the right or attribute or none): fixed values.
RIGHTS = [
    ("GenericAll", (), "GENERIC_ALL", None),
    ("WriteAll", (), "GENERIC_WRITE", None),
    ("WritePropertyAll", (), "DS_WRITE_PROPERTY", None),
    ("WriteExtendedAll", (), "DS_WRITE_PROPERTY_EXTENDED", None),
    ("TakeOwnership", (), "WRITE_OWNER", None),
    ("WriteDACL", (), "WRITE_DACL", None),
    ("AllExtendedRights", (), "DS_CONTROL_ACCESS", None),
    ("ResetPassword", ("User", "Computer"), "DS_CONTROL_ACCESS", "00299570-246d-11d0-a768-00aa006e0529"),
    ("WriteSPN", ("User",), "DS_WRITE_PROPERTY", "f3a64788-5306-11d1-a9c5-0000f80367c1"),
    ("WriteValidatedSPN", ("User",), "DS_WRITE_PROPERTY_EXTENDED", "f3a64788-5306-11d1-a9c5-0000f80367c1"),
    ("WriteAllowedToAct", ("User", "Computer"), "DS_WRITE_PROPERTY", "3f78c3e5-f79a-46bd-a0b8-9d18116ddc79"),
    ("AddMember", ("Group",), "DS_WRITE_PROPERTY", "bf9679c0-0de6-11d0-a285-00aa003049e2"),
    ("AddMemberGroupAttr", ("Group",), "DS_WRITE_PROPERTY", "bc0ac240-79a9-11d0-9020-00c04fc2d4cf"),
    ("AddSelfMember", ("Group",), "DS_WRITE_PROPERTY_EXTENDED", "bf9679c0-0de6-11d0-a285-00aa003049e2"),
    ("WriteKeyCredentialLink", ("User", "Computer"), "DS_WRITE_PROPERTY", "5b47d60f-6090-40b2-9f37-2a4de88f3063"),
    ("WriteUserAccountControl", ("User",), "DS_WRITE_PROPERTY", "bf967a68-0de6-11d0-a285-00aa003049e2"),
    ("WriteAltSecIdent", ("User",), "DS_WRITE_PROPERTY", "00fbf30c-91fe-11d1-aebc-0000f80367c1"),
    ("WriteProfilePath", ("User",), "DS_WRITE_PROPERTY", "bf967a05-0de6-11d0-a285-00aa003049e2"),
    ("WriteScriptPath", ("User",), "DS_WRITE_PROPERTY", "bf9679a8-0de6-11d0-a285-00aa003049e2"),
    ("WriteAttrSecurityGUID", ("AttributeSchema",), "DS_WRITE_PROPERTY", "bf967924-0de6-11d0-a285-00aa003049e2"),
    ("ReadPasswordId", ("GroupManagedServiceAccount",), "DS_READ_PROPERTY", "0e78295a-c6d3-0a40-b491-d62251ffa0a6"),
    ("CertificateEnroll", ("CertificateTemplate",), "DS_CONTROL_ACCESS", "0e10c968-78fb-11d2-90d4-00c04f79dc55"),
    ("CertificateEnroll", ("CertificateTemplate",), "DS_VOODOO_BIT", None),
    ("CertificateAutoEnroll", ("CertificateTemplate",), "DS_CONTROL_ACCESS", "a05b8cc2-17bc-4802-a710-e7c15ab866a2"),
    ("CertificateAutoEnroll", ("CertificateTemplate",), "DS_VOODOO_BIT", None),
    ("VoodooBit", (), "DS_VOODOO_BIT", None),
    ("DSReplGetChngs", ("DomainDNS",), "DS_CONTROL_ACCESS", "1131f6aa-9c07-11d1-f79f-00c04fc2dcd2"),
    ("DSReplGetChngsAll", ("DomainDNS",), "DS_CONTROL_ACCESS", "1131f6ad-9c07-11d1-f79f-00c04fc2dcd2"),
    ("DSReplGetChngsInFiltSet", ("DomainDNS",), "DS_CONTROL_ACCESS", "89e95b76-444d-4c62-991a-0facbeda640c"),
    ("DSReplSync", ("DomainDNS",), "DS_CONTROL_ACCESS", "1131f6ab-9c07-11d1-f79f-00c04fc2dcd2"),
]


def ace_matches(ace: Column, mask: int, guid: str | None, class_guids: Column | None = None, property_sets: tuple[str, ...] = ()) -> Column:
    """All bits of the mask, not inherit-only; the entry's object type is absent, the GUID, or a property set that the
    attribute is in; its inherited object type is absent or among the node's class GUIDs. Without a guid only entries without an object type match."""
    none = lambda c: c.isNull() | (c == NO_GUID)
    wanted = [g.lower() for g in (guid, *property_sets) if g]
    object_fits = none(ace["object_type"]) | (F.lower(ace["object_type"]).isin(*wanted) if wanted else F.lit(False))
    classes = F.transform(class_guids, F.lower) if class_guids is not None else F.array().cast("array<string>")
    class_fits = none(ace["inherited_object_type"]) | F.array_contains(classes, F.lower(ace["inherited_object_type"]))
    live = ace["aceflags"].bitwiseAND(F.lit(INHERIT_ONLY)) == 0
    return F.coalesce(live & (ace["mask"].bitwiseAND(F.lit(mask)) == mask) & object_fits & class_fits, F.lit(False))


def allowed_sids(dacl: Column, mask: int, guid: str | None = None, class_guids: Column | None = None, property_sets: tuple[str, ...] = ()) -> Column:
    """Distinct security ids that an entry allows the access and no earlier entry for the same id denies it."""
    fits = lambda a: ace_matches(a, mask, guid, class_guids, property_sets)
    allow = F.filter(dacl, lambda a: a["type"].isin(*GRANTS) & fits(a))
    open_ones = F.filter(allow, lambda a: ~F.exists(dacl, lambda d: d["type"].isin(*DENIALS) & (d["sid"] == a["sid"]) & (d["ord"] < a["ord"]) & fits(d)))
    return F.coalesce(F.array_distinct(F.transform(open_ones, lambda a: a["sid"])), F.array().cast("array<string>"))


def property_sets_of(schema: DataFrame, guids: list[str]) -> dict[str, tuple[str, ...]]:
    """schema (guid, set_guid) of attributes -> the sets of each of a few guids."""
    low = schema.select(F.lower("guid").alias("guid"), F.lower("set_guid").alias("set_guid")).where("set_guid is not null")
    rows = low.where(F.col("guid").isin(*guids)).groupBy("guid").agg(F.array_sort(F.collect_set("set_guid")).alias("sets")).collect()
    return {r["guid"]: tuple(r["sets"]) for r in rows}


def decided(objects: DataFrame, rights, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """(dst, sid, denies, r0, r1, ...) of the entries of objects (node_id, type, descriptor, class_guids): for each security id
    an object's list names, whether it denies it anything, and for each right twice the place of the first entry that fits,
    plus one where that denies; null where none fits.

    An id has a right when a fitting entry allows it and no earlier one denies it, that is, when the first fitting entry
    allows. So one pass over exploded entries is enough, whose minima for all rights are taken at once, in each task
    before the shuffle; the work is in proportion to the entries, and a list of any length is many rows."""
    entry = objects.select("node_id", "type", F.transform("class_guids", F.lower).alias("classes"), F.explode("descriptor.dacl").alias("a"))
    a = F.col("a")
    none = lambda c: c.isNull() | (c == NO_GUID)
    flat = entry.where(a["type"].isin(*GRANTS, *DENIALS)).select(
        F.col("node_id").alias("dst"), "type", a["sid"].alias("sid"), a["mask"].alias("mask"), F.lower(a["object_type"]).alias("object_type"), none(a["object_type"]).alias("any_type"),
        a["type"].isin(*DENIALS).alias("denies"), (a["ord"].cast("long") * 2 + a["type"].isin(*DENIALS).cast("long")).alias("place"),
        ((a["aceflags"].bitwiseAND(F.lit(INHERIT_ONLY)) == 0) & (none(a["inherited_object_type"]) | F.coalesce(F.array_contains("classes", F.lower(a["inherited_object_type"])), F.lit(False)))).alias("live"),
    )
    firsts = []
    for i, (_, types, mask, guid) in enumerate(rights):
        wanted = [g.lower() for g in (guid, *sets.get((guid or "").lower(), ())) if g]
        named = F.col("any_type") | F.col("object_type").isin(*wanted) if wanted else F.col("any_type")
        of_type = F.col("type").isin(*types) if types else F.lit(True)
        fits = F.col("live") & of_type & (F.col("mask").bitwiseAND(F.lit(MASKS[mask])) == MASKS[mask]) & named
        firsts.append(F.min(F.when(fits, F.col("place"))).alias(f"r{i}"))
    return flat.groupBy("dst", "sid").agg(F.max("denies").alias("denies"), *firsts)


def access_edges(objects: DataFrame, principals: DataFrame, rights=RIGHTS, schema: DataFrame | None = None) -> DataFrame:
    """objects (node_id, type, descriptor, class_guids), principals (node_id, sid) -> edges (src, dst, edge_type, prob).

    schema: (guid, set_guid) of attributes; an entry for an attribute's set grants the attribute too. All rights are
    decided in one pass over the entries, see decided(); security ids are then resolved by one join. An edge of a principal
    to itself, and one between nodes of one security id, is not made."""
    sets = property_sets_of(schema, sorted({g.lower() for *_, g in rights if g})) if schema is not None else {}
    granted = [F.when(F.col(f"r{i}") % 2 == 0, F.lit(edge)) for i, (edge, *_) in enumerate(rights)]
    names = F.array_distinct(F.array_compact(F.array(F.when(F.col("denies"), F.lit("ACLContainsDeny")), *granted)))
    found = decided(objects, rights, sets).select("dst", F.explode(names).alias("edge_type"), "sid")
    owners = objects.select(F.col("node_id").alias("dst"), F.lit("Owns").alias("edge_type"), F.col("descriptor.owner").alias("sid")).where("sid is not null")
    return resolved_edges(found.union(owners), principals)


def resolved_edges(found: DataFrame, principals: DataFrame) -> DataFrame:
    """found (dst, edge_type, sid) -> edges from the principals of these security ids."""
    known = principals.select("node_id", "sid")
    joined = found.join(known.withColumnRenamed("node_id", "src"), "sid").join(known.select(F.col("node_id").alias("dst"), F.col("sid").alias("own")), "dst", "left")
    apart = (F.col("src") != F.col("dst")) & ~F.col("sid").eqNullSafe(F.col("own")) & (F.col("sid") != SELF)
    return joined.where(apart).select("src", "dst", "edge_type", F.lit(100).alias("prob")).distinct()


def descriptor_grants(objects: DataFrame, principals: DataFrame, column: str, edge: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Edges from whom plain allow entries of a descriptor attribute name: who may act on behalf of others to an account
    (RBConstrainedDeleg), who may read a managed password (ReadGMSAPassword)."""
    of_type = objects.where(F.col("type").isin(*types)) if types else objects
    entry = F.explode(F.filter(F.col(column)["dacl"], lambda a: a["type"] == ALLOWED)).alias("a")
    found = of_type.select(F.col("node_id").alias("dst"), entry).select("dst", F.lit(edge).alias("edge_type"), "a.sid")
    return resolved_edges(found, principals)


def sync_rights(edges: DataFrame) -> DataFrame:
    """DCsync edges: principals with both Get-Changes and Get-Changes-All on a domain."""
    both = edges.where(F.col("edge_type").isin("DSReplGetChngs", "DSReplGetChngsAll")).groupBy("src", "dst").agg(F.count_distinct("edge_type").alias("n")).where("n = 2")
    return both.select("src", "dst", F.lit("DCsync").alias("edge_type"), F.lit(100).alias("prob"))


def canonical_order(dacl: Column) -> Column:
    """Explicit denials, explicit grants, inherited denials, inherited grants; in their order within each, numbered anew."""
    rank = lambda a: F.when(a["aceflags"].bitwiseAND(F.lit(INHERITED)) != 0, 2).otherwise(0) + F.when(a["type"].isin(*DENIALS), 0).otherwise(1)
    keyed = F.array_sort(F.transform(dacl, lambda a: F.struct(rank(a).alias("r"), a["ord"].alias("o"), a.alias("a"))), lambda x, y: F.when(x["r"] != y["r"], x["r"] - y["r"]).otherwise(x["o"] - y["o"]))
    return F.transform(keyed, lambda k, i: k["a"].withField("ord", i.cast("int")))


def _sid(raw: bytes, at: int) -> tuple[str | None, int]:
    if at <= 0 and not raw or at + 8 > len(raw):
        return None, at
    n = raw[at + 1]
    subs = [int.from_bytes(raw[at + 8 + 4 * i : at + 12 + 4 * i], "little") for i in range(n)]
    return "-".join(map(str, ("S", raw[at], int.from_bytes(raw[at + 2 : at + 8], "big"), *subs))), at + 8 + 4 * n


#: Codes of the byte code of conditions: names of attributes, literals, and operators with their number of operands. Fixed
#: values of the format.
NAMES = range(0xF8, 0xFC)
INTEGER, TEXT, OCTETS, COMPOSITE, SID_LITERAL = 0x04, 0x10, 0x18, 0x50, 0x51
OPERATORS = {
    0x80: ("==", 2), 0x81: ("!=", 2), 0x82: (">", 2), 0x83: (">=", 2), 0x84: ("<", 2), 0x85: ("<=", 2),
    0x86: ("Any_of", 2), 0x87: ("Contains", 2), 0x88: ("Member_of", 2), 0x8A: ("Exists", 1),
}
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}


def _quoted(text: str) -> str:
    shown = (_ESCAPES.get(c) or (c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 0x80 else f"\\u{ord(c):04x}") for c in text)
    return '"' + "".join(shown) + '"'


class Malformed(ValueError):
    pass


class _Reader:
    """Counted fields of a condition, one after the other."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise Malformed("a field goes beyond the end")
        self.at += n
        return self.raw[self.at - n : self.at]

    def counted(self) -> bytes:
        return self.take(int.from_bytes(self.take(4), "little"))

    def text(self) -> str:
        raw = self.counted()
        if len(raw) % 2:
            raise Malformed("a text of half a character")
        return raw.decode("utf-16-le", "replace")

    def literal(self, code: int) -> str | None:
        """The literal that a code begins, in its text form; None of a code that begins none."""
        if code == INTEGER:
            value = int.from_bytes(self.take(8), "little", signed=True)
            self.take(2)  # sign and base say how it was written
            return str(value)
        if code == TEXT:
            return _quoted(self.text())
        if code == OCTETS:
            return "#" + self.counted().hex().upper()
        if code == SID_LITERAL:
            sid = _sid(self.counted() + b"", 0)[0]
            if sid is None:
                raise Malformed("a security id that is too short")
            return f"SID({sid})"
        if code == COMPOSITE:
            inner, parts = _Reader(self.counted()), []
            while inner.at < len(inner.raw):
                kind = inner.take(1)[0]
                if kind not in (TEXT, SID_LITERAL):  # others are shown as they stand
                    parts.append("0x" + inner.raw[inner.at - 1 :].hex().upper())
                    break
                parts.append(inner.literal(kind))
            return "{" + ",".join(parts) + "}"
        return None


def condition_text(raw: bytes) -> str:
    """The expression of a conditional entry, from its byte code (postfix, behind the mark "artx", padded with zeros), in
    infix form; Malformed where the code is not one expression."""
    if raw[:4] != b"artx":
        raise Malformed("no mark of a condition")
    reader, stack = _Reader(raw), []
    reader.at = 4
    while reader.at < len(raw) and any(raw[reader.at :]):
        code = reader.take(1)[0]
        if code in NAMES:
            stack.append(reader.text())
        elif (shown := reader.literal(code)) is not None:
            stack.append(shown)
        else:
            name, n = OPERATORS.get(code, (f"OP(0x{code:02X})", 0))
            if len(stack) < n:
                raise Malformed(f"{name} has too few operands")
            operands = [stack.pop() for _ in range(n)][::-1]
            stack.append(f"({operands[0]} {name} {operands[1]})" if n == 2 else f"{name}({operands[0]})" if n else name)
    if len(stack) != 1:
        raise Malformed(f"{len(stack)} expressions")
    return stack[0]


def _condition(raw: bytes) -> str | None:
    try:
        return condition_text(raw)
    except Malformed:
        return None


def _guid(raw: bytes) -> str:
    import uuid

    return str(uuid.UUID(bytes_le=raw))


def _descriptor(raw: bytes | None) -> dict | None:
    """One self-relative descriptor; None where it is too short."""
    if raw is None or len(raw) < 20:
        return None
    word = lambda a, n=4: int.from_bytes(raw[a : a + n], "little")
    owner, group, _, dacl = (word(4 + 4 * i) for i in range(4))
    aces = []
    if dacl and dacl + 8 <= len(raw):
        at = dacl + 8
        for ord_ in range(word(dacl + 4, 2)):
            size = word(at + 2, 2)
            if size < 8 or at + size > len(raw):
                break
            kind, flags, mask, p = raw[at], 0, word(at + 4), at + 8
            object_type = inherited = None
            if kind in (ALLOWED_OBJECT, DENIED_OBJECT):
                flags, p = word(p), p + 4
                if flags & 1:
                    object_type, p = _guid(raw[p : p + 16]), p + 16
                if flags & 2:
                    inherited, p = _guid(raw[p : p + 16]), p + 16
            sid, after = _sid(raw, p)
            condition = _condition(raw[after : at + size]) if kind == ALLOWED_IF else None
            aces.append({"ord": ord_, "type": kind, "aceflags": raw[at + 1], "flags": flags, "mask": mask, "sid": sid, "object_type": object_type, "inherited_object_type": inherited, "condition": condition})
            at += size
    return {"control": word(2, 2), "owner": _sid(raw, owner)[0] if owner else None, "grp": _sid(raw, group)[0] if group else None, "dacl": aces}


def parsed_descriptor(raw: Column) -> Column:
    """Binary self-relative security descriptors as structs with their entries in canonical order, by an Arrow-batched
    function; null where the bytes are too short. Parse distinct ones only."""

    @F.pandas_udf(DESCRIPTOR)
    def parse(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_descriptor(x) or {"control": None, "owner": None, "grp": None, "dacl": None} for x in column], columns=["control", "owner", "grp", "dacl"])

    found = parse(raw)
    ordered = F.struct(found["control"].alias("control"), found["owner"].alias("owner"), found["grp"].alias("grp"), canonical_order(found["dacl"]).alias("dacl"))
    return F.when(found["control"].isNotNull(), ordered)
