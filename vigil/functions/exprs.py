"""Column builders shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import fixed_values as fx

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, list(conditions), F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, list(conditions), F.lit(True))


def java_pattern(layout: str, any_case: bool = False) -> str:
    """A layout of the fixed values for Java: without the names of its groups, and only a line feed ends a line."""
    return ("(?id)" if any_case else "(?d)") + re.sub(r"\(\?P<\w+>", "(", layout)


def once(expensive: Column) -> Column:
    """Keep the optimizer from copying an expensive expression.

    A filter on a derived column is pushed below the projection by substituting the whole expression into it, and
    again into the next one. An expression that is not deterministic by declaration (it is in fact) stays in one place.
    """
    return F.when(F.spark_partition_id() >= 0, expensive)


# what counts as white space at the ends of a text
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a" \
    "\u2028\u2029\u202f\u205f\u3000"


def strip(col) -> Column:
    """Trim every kind of white space (plain ``trim`` only removes blanks)."""
    return F.btrim(col, F.lit(BLANKS))


def blank_to_null(col) -> Column:
    text = strip(col)
    return F.when(F.length(text) > 0, text)


def truthy(col) -> Column:
    return F.coalesce(F.length(col) > 0, F.lit(False))


def or_else(*cols) -> Column:
    """First non-null, non-empty string."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in cols])


def contains_any(col, words) -> Column:
    return F.coalesce(any_of(col.contains(w) for w in words), F.lit(False))


def starts_with_any(col, prefixes) -> Column:
    return F.coalesce(any_of(col.startswith(p) for p in prefixes), F.lit(False))


def matches_any(col, patterns) -> Column:
    """One case-insensitive alternation instead of one scan per pattern."""
    return F.coalesce(col.rlike("(?i)(?:" + "|".join(patterns) + ")"), F.lit(False))


def sha_of(*parts, sep="|") -> Column:
    safe = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(sep, *safe), 256)


def micros(ts) -> Column:
    """Epoch microseconds; the session time zone is pinned to UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def severity_index(col) -> Column:
    """Position on the five-level alert scale; -1 for unknown names."""
    return F.array_position(F.array(*map(F.lit, fx.ALERT_SEVERITIES)), F.lower(col)).cast("int") - 1


def severity_name(idx) -> Column:
    return F.get(F.array(*map(F.lit, fx.ALERT_SEVERITIES)), idx)


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9a-fA-F]{1,4}"


def _ipv6_pattern() -> str:
    full = rf"(?:{_H}:){{7}}{_H}"
    v4_tail = rf"(?:{_H}:){{6}}{_IPV4}"
    compressed = [rf"(?:{_H}:){{1,{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(1, 7)]
    edge = [rf":(?::{_H}){{1,7}}", rf"(?:{_H}:){{1,7}}:", "::"]
    v4_short = [rf"::(?:{_H}:){{0,5}}{_IPV4}"] + [
        rf"(?:{_H}:){{1,{n}}}:(?:{_H}:){{0,{5 - n}}}{_IPV4}" for n in range(1, 6)
    ]
    return "(?:" + "|".join([full, v4_tail, *compressed, *edge, *v4_short]) + r")(?:%[^%/]+)?"


def is_ipv4(col) -> Column:
    return F.coalesce(col.rlike(f"^{_IPV4}$"), F.lit(False))


def is_ip(col) -> Column:
    """IPv4 or IPv6 literal; null is not an address."""
    return F.coalesce(col.rlike(f"^(?:{_IPV4}|{_ipv6_pattern()})$"), F.lit(False))


def ipv4_to_long(col) -> Column:
    """Numeric IPv4 address, null for anything else."""
    octets = F.transform(F.split(col, r"\."), lambda o: o.try_cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(is_ipv4(col), number)


def in_blocks(number, blocks) -> Column:
    def inside(block):
        net = ipaddress.ip_network(block)
        return number.between(int(net.network_address), int(net.broadcast_address))

    return F.coalesce(any_of(inside(b) for b in blocks), F.lit(False))


def is_private_v4(number) -> Column:
    return in_blocks(number, fx.PRIVATE_BLOCKS) & ~in_blocks(number, fx.PRIVATE_EXCEPTIONS)


_ISO = (
    r"^\d{4}-?\d{2}-?\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?"
    r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"
)


def iso_timestamp(text) -> Column:
    """ISO-8601 text to an instant, null when the text is not ISO-8601. No zone means UTC."""
    t = strip(text)
    compact = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    spaced = F.regexp_replace(compact, r"^(\d{4}-\d{2}-\d{2})[T ]", "$1T")
    timed = F.regexp_replace(spaced, r"T(\d{2})(\d{2})(\d{2})?(?=$|[.,Z+\-])", "T$1:$2:$3")
    hours = F.regexp_replace(timed, r"T(\d{2})(?=$|[Z+\-])", "T$1:00")
    zone = F.regexp_replace(hours, r"([+-]\d{2})(\d{2})$", "$1:$2")
    fixed = F.when(spaced.contains("T"), F.regexp_replace(F.regexp_replace(zone, ",", "."), r":(?=$|[Z+])", "")).otherwise(spaced)
    return F.when(t.rlike(_ISO), fixed.try_cast("timestamp"))


def event_time(text) -> Column:
    """Epoch seconds or ISO-8601 text; null when neither."""
    t = strip(text)
    number = F.when(t.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$") & ~t.rlike(r"^\d{8}$"), t.try_cast("double"))
    return F.coalesce(F.timestamp_micros((number * 1_000_000).cast("bigint")), iso_timestamp(t))


def clf_time(text) -> Column:
    """``10/Oct/2000:13:55:36 -0700``."""
    return F.try_to_timestamp(strip(text), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def iso_text(ts) -> Column:
    """Instant as ISO-8601 text in UTC, fraction only when present."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.unix_micros(ts) % 1_000_000
    return F.concat(
        base, F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00")
    )
