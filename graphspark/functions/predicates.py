"""Node predicates as two-valued Columns over the map `attrs`: a predicate of a missing attribute is false, never null.

A predicate holds when any value of the attribute satisfies it, unless said otherwise. Combine with &, | and ~.
"""

from __future__ import annotations

import fnmatch
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def values_of(attr: str) -> Column:
    return F.col("attrs")[attr.lower()]


def _any(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def _lift(attr: str | None, test: Callable[[Column], Column]) -> Column:
    """attr: a name; a glob of names (case-sensitive) if it holds * or ?; None for all attributes."""
    if attr is None:
        return _any(F.flatten(F.map_values("attrs")), test)
    if re.search(r"[*?]", attr):
        pattern = fnmatch.translate(attr).replace("(?s:", "(?:").replace(r"\Z", "").replace(r"\z", "")
        chosen = F.map_filter("attrs", lambda k, _: k.rlike(f"^{pattern}$"))
        return _any(F.flatten(F.map_values(chosen)), test)
    return _any(values_of(attr), test)


def equals(attr: str | None, text: str, exact: bool = False) -> Column:
    """Equality with the text form, ignoring case unless exact."""
    return _lift(attr, (lambda v: v["s"] == text) if exact else (lambda v: F.lower(v["s"]) == text.lower()))


def present(attr: str) -> Column:
    return F.coalesce(F.size(values_of(attr)) > 0, F.lit(False))


def glob(attr: str | None, pattern: str, exact: bool = False) -> Column:
    """Full match of * (any run), ? (one character), [ab], [a-z] and [!a] (one of, none of) and {one,two} (either, which may
    hold the others); simple forms become startswith, endswith and contains. A bracket that is not closed stands for itself."""
    want = pattern if exact else pattern.lower()
    fold = (lambda v: v["s"]) if exact else (lambda v: F.lower(v["s"]))
    inner = want.strip("*")
    if not re.search(r"[*?\[\]{}]", inner):
        lead, trail = want.startswith("*"), want.endswith("*")
        if lead and trail:
            return _lift(attr, lambda v: fold(v).contains(inner))
        if trail:
            return _lift(attr, lambda v: fold(v).startswith(inner))
        if lead:
            return _lift(attr, lambda v: fold(v).endswith(inner))
        return _lift(attr, lambda v: fold(v) == inner)
    return _lift(attr, lambda v: fold(v).rlike(f"(?s)^{glob_regex(want)}$"))


def glob_regex(pattern: str) -> str:
    """The pattern as a regular expression without anchors."""
    out, open_braces, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else pattern.find("}", i) if c == "{" else -1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and close > 0:
            inner = pattern[i + 1 : close]
            none = inner[0] in "!^"
            inside = re.sub(r"([\\^&\[])", r"\\\1", inner[none:])
            out.append(f"[{'^' if none else ''}{inside}]")
            i = close
        elif c == "{" and close > 0:
            open_braces += 1
            out.append("(?:")
        elif open_braces and c == ",":
            out.append("|")
        elif open_braces and c == "}":
            open_braces -= 1
            out.append(")")
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def regex(attr: str | None, pattern: str) -> Column:
    """Unanchored, case-sensitive."""
    return _lift(attr, lambda v: v["s"].rlike(pattern))


def compare(attr: str | None, op: str, number: float) -> Column:
    """By the value's kind: int and float as numbers, others as text ignoring case."""
    f = COMPARE[op]
    text = str(number).lower()
    return _lift(attr, lambda v: F.when(v["k"] == "int", f(v["i"], F.lit(number))).when(v["k"] == "float", f(v["f"], F.lit(float(number)))).otherwise(f(F.lower(v["s"]), F.lit(text))))


def count(attr: str, op: str, n: int) -> Column:
    """Number of values; 0 of a missing attribute."""
    return COMPARE[op](F.coalesce(F.size(values_of(attr)), F.lit(0)), F.lit(n))


def length(attr: str, op: str, n: int) -> Column:
    """Bytes of the text form of any value; a missing attribute compares as 0."""
    f = COMPARE[op]
    return F.when(present(attr), _any(values_of(attr), lambda v: f(F.octet_length(v["s"]), F.lit(n)))).otherwise(f(F.lit(0), F.lit(n)))


def since(attr: str, op: str, asof: str, years: int = 0, months: int = 0, days: int = 0, hours: int = 0) -> Column:
    """A time against asof plus a span, to the second; `since(a, "<", now, years=-5)` is older than five years."""
    limit = F.unix_timestamp(F.lit(asof).cast("timestamp") + F.make_interval(F.lit(years), F.lit(months), F.lit(0), F.lit(days), F.lit(hours)))
    return _any(values_of(attr), lambda v: COMPARE[op](F.unix_timestamp(v["t"]), limit))


def time_difference(attr: str, other: str, op: str, days: int = 0, hours: int = 0) -> Column:
    """Some value i of attr compares with value i of other plus the span; both have the same number of values."""
    span = F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days), F.lit(hours))
    a, b = values_of(attr), values_of(other)
    hit = F.exists(F.zip_with(a, b, lambda x, y: COMPARE[op](F.unix_timestamp(x["t"]), F.unix_timestamp(y["t"] + span))), lambda z: F.coalesce(z, F.lit(False)))
    return F.coalesce((F.size(a) == F.size(b)) & hit, F.lit(False))


def bits_all(attr: str, mask: int) -> Column:
    """All bits of the mask in the only value."""
    v = values_of(attr)
    return F.coalesce((F.size(v) == 1) & (v[0]["i"].bitwiseAND(F.lit(mask)) == mask), F.lit(False))


def bits_any(attr: str, mask: int) -> Column:
    v = values_of(attr)
    return F.coalesce((F.size(v) == 1) & (v[0]["i"].bitwiseAND(F.lit(mask)) != 0), F.lit(False))


def node_id(op: str, n: int) -> Column:
    return COMPARE[op](F.col("node_id"), F.lit(n))


def of_type(name: str) -> Column:
    return F.coalesce(F.lower("type") == name.lower(), F.lit(False))


def random100(op: str, n: int, seed: int | None = None) -> Column:
    """0 to 99 per node: by a hash of the id (seed None), or at random."""
    r = F.pmod(F.xxhash64("node_id"), F.lit(100)) if seed is None else F.floor(F.rand(seed) * 100)
    return COMPARE[op](r, F.lit(n))


def all_of(*tests: Column) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def any_of(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
