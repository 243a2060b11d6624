"""Scalar functions on distinguished names, security ids, times and labels, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A component of a distinguished name: a backslash escapes what follows it, itself too.
_COMPONENT = r"(?:[^,\\]|\\.)*"


def dn_parts(dn: Column) -> Column:
    """The components, which commas separate that no backslash escapes."""
    return F.regexp_extract_all(dn, F.lit(rf"(?:^|,)({_COMPONENT})"), 1)


def dn_parent(dn: Column) -> Column:
    """What follows the first comma that no backslash escapes; null where there is none."""
    return F.when(dn.rlike(rf"^{_COMPONENT},"), F.regexp_replace(dn, rf"^{_COMPONENT},", ""))


def dn_domain(dn: Column) -> Column:
    """The DC components, in order."""
    parts = F.filter(dn_parts(dn), lambda p: F.upper(F.trim(p)).startswith("DC="))
    return F.array_join(F.transform(parts, lambda p: F.trim(p)), ",")


def domain_suffix(context: Column) -> Column:
    """DC=a,DC=b as a.b in lower case."""
    return F.array_join(F.transform(F.split(context, ","), lambda p: F.lower(F.regexp_replace(F.trim(p), "(?i)^DC=", ""))), ".")


def sid_rid(sid: Column) -> Column:
    return F.element_at(F.split(sid, "-"), -1).cast("bigint")


def sid_domain(sid: Column) -> Column:
    parts = F.split(sid, "-")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-")


def binary_sid(raw: Column) -> Column:
    """The text of a security id in its binary form: revision, number of sub-authorities, a big-endian authority of six bytes
    and little-endian sub-authorities of four; null where bytes are missing."""
    h = F.hex(raw)
    number = lambda at, n: F.conv(F.substring(h, 2 * at + 1, 2 * n), 16, 10)
    count = number(1, 1).cast("int")
    pair = lambda at: h.substr(at * 2 + 1, F.lit(2))
    word = lambda i: F.conv(F.concat(*[pair(i * 4 + (8 + k)) for k in (3, 2, 1, 0)]), 16, 10)
    subs = F.transform(F.sequence(F.lit(0), count - 1), word)
    text = F.concat_ws("-", F.lit("S"), number(0, 1), number(2, 6), F.when(count > 0, F.array_join(subs, "-")))
    return F.when((F.octet_length(raw) >= 8) & (F.octet_length(raw) >= count * 4 + 8), text)


def plain_guid(hexed: Column) -> Column:
    """32 hex digits of a GUID's bytes, in the order in which they stand."""
    return F.lower(F.concat_ws("-", *[hexed.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def service_sid(name: Column) -> Column:
    """S-1-5-80 and the five little-endian words of the SHA-1 of the upper-case name in UTF-16LE."""
    h = F.sha1(F.encode(F.upper(name), "UTF-16LE"))
    word = lambda i: F.conv(F.concat(*[h.substr(8 * i + 2 * k + 1, 2) for k in (3, 2, 1, 0)]), 16, 10)
    return F.concat_ws("-", F.lit("S-1-5-80"), *[word(i) for i in range(5)])


def filetime(ticks: Column) -> Column:
    """100 ns since 1601; 0 and all ones are no time, later times are the end of 9999."""
    micros = F.least(F.floor(ticks / 10).cast("bigint") - F.lit(11644473600000000), F.lit(253402300799000000))
    return F.when((ticks != 0) & (ticks != -1) & (ticks != 9223372036854775807), F.timestamp_micros(micros))


def generalized_time(text: Column) -> Column:
    """yyyyMMddHHmmss or yyMMddHHmmss (69 to 99 are of the last century), with a fraction or zone mark that is dropped."""
    digits = F.regexp_extract(text, r"^(\d{14}|\d{12})", 1)
    full = F.when(F.length(digits) == 14, digits).when(F.length(digits) == 12, F.concat(F.when(digits.substr(1, 2) >= "69", "19").otherwise("20"), digits))
    return F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))


#: Label attributes in their order: fixed values.
LABEL_ORDER = ("displayname", "name", "downlevellogonname", "samaccountname", "description", "distinguishedname", "objectguid", "objectsid")


def label(order: tuple[str, ...] = LABEL_ORDER) -> Column:
    """The first attribute of the order that is not blank."""
    return F.coalesce(*[F.when(F.trim(F.col("attrs")[a][0]["s"]) != "", F.col("attrs")[a][0]["s"]) for a in order])


def dotted_guid(hexed: Column) -> Column:
    """32 hex digits of a GUID's bytes in the usual form: the first three groups are little-endian."""
    pair = lambda k: hexed.substr(2 * k + 1, 2)
    return F.lower(F.concat(*[pair(k) for k in (3, 2, 1, 0)], F.lit("-"), pair(5), pair(4), F.lit("-"), pair(7), pair(6), F.lit("-"), hexed.substr(17, 4), F.lit("-"), hexed.substr(21, 12)))


#: Attributes that identify a node, in their order: fixed values.
PRIMARY_ORDER = ("distinguishedname", "objectguid", "objectsid")


def primary_id(order: tuple[str, ...] = PRIMARY_ORDER) -> Column:
    """struct(attr, value) of the first attribute of the order that the node has; null without any."""
    return F.coalesce(*[F.when(F.size(F.col("attrs")[a]) > 0, F.struct(F.lit(a).alias("attr"), F.col("attrs")[a][0]["s"].alias("value"))) for a in order])


def meta_attributes() -> Column:
    """Attributes whose name begins with _, as a map to their first texts."""
    return F.transform_values(F.map_filter("attrs", lambda k, _: k.startswith("_")), lambda _, v: v[0]["s"])


_UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S}\x20]"


def is_printable(text: Column) -> Column:
    """Letters, marks, numbers, punctuation, symbols and the space alone; true of the empty text."""
    return ~text.rlike(_UNPRINTABLE)


def hexified(text: Column) -> Column:
    """Characters that do not print as \\x and their code point in hexadecimal digits."""
    shown = lambda c: F.when(c.rlike(_UNPRINTABLE), F.concat(F.lit("\\x"), F.lower(F.hex(_code_point(c))))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), shown), "")


def _code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")


#: Spans in seconds that a period is told in, the longest first: fixed values.
SPANS = (("years", 31536000), ("months", 2592000), ("weeks", 604800), ("days", 86400), ("hours", 3600))


def pki_period(ticks: Column) -> Column:
    """A period of 100 ns ticks in the longest span of which it is a multiple, and more than one; null where there is none."""
    seconds = F.floor(ticks / 10_000_000)
    return F.coalesce(*[F.when((seconds % n == 0) & (seconds / n > 1), F.concat_ws(" ", (seconds / n).cast("bigint"), F.lit(name))) for name, n in SPANS])
