"""Column helpers shared by all operators. Everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.schemas import FIELDS, NTZ


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once inside a higher-order expression, so it is not re-evaluated per use.

    An aggregate over no elements hands its start value to its finish function. Unlike a transform
    of a one-element array it does not copy the result, which matters when bindings nest.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def coerce(value: Column) -> Column:
    """Any scalar to text; null becomes the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def fingerprint(fields: Column) -> Column:
    """SHA-256 over `name=value` pairs of the canonical fields."""
    parts: list[Column] = []
    for i, name in enumerate(FIELDS):
        parts += [F.lit(("|" if i else "") + name + "="), coerce(fields[name])]
    return F.sha2(F.concat(*parts), 256)


def same_value(a: Column, b: Column) -> Column:
    """Equality where a missing value equals null."""
    return a.cast("string").eqNullSafe(b.cast("string"))


def same_fields(a: Column, b: Column) -> Column:
    """True when two field sets agree on every known field; null and '' differ."""
    out = F.lit(True)
    for name in FIELDS:
        out = out & same_value(a[name], b[name])
    return out


def compose_id(*parts: Column | str) -> Column:
    """Deterministic ids such as `jobsync:<job>:<record>`; plain strings are literals."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def event_key(tenant: Column, entity_type: Column, entity_id: Column) -> Column:
    """Partition key of a published event."""
    return F.concat_ws(":", tenant, entity_type, entity_id)


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text to UTC wall clock; null when it does not parse."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    # The offset is applied by hand so that the result does not depend on the session zone.
    wall = F.regexp_replace(F.substring(text, 1, 19), "T", " ").try_cast(NTZ)
    fraction = F.rpad(F.coalesce(F.nullif(F.regexp_extract(text, r"\.(\d{1,6})", 1), F.lit("")), F.lit("0")), 6, "0")
    sign = F.when(text.rlike(r"-\d{2}:\d{2}$"), F.lit(1)).otherwise(F.lit(-1))
    hours = F.regexp_extract(text, r"[+-](\d{2}):\d{2}$", 1).try_cast("int")
    mins = F.regexp_extract(text, r"[+-]\d{2}:(\d{2})$", 1).try_cast("int")
    offset = sign * (F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(mins, F.lit(0)))
    shifted = wall + F.make_dt_interval(mins=offset, secs=fraction.cast("decimal(18,6)") / F.lit(1000000))
    return F.when(shaped, shifted)


def decode_snapshot(text: Column) -> Column:
    """A stored field snapshot as a map; text that is not an object becomes `{raw: text}`."""
    parsed = F.from_json(text, "map<string,string>")
    return F.when(parsed.isNotNull(), parsed).otherwise(F.create_map(F.lit("raw"), F.trim(text)))


def decode_provenance(text: Column) -> Column:
    from concord.schemas import WRITER_DDL

    return F.from_json(text, f"map<string,{WRITER_DDL}>")


def encode_provenance(value: Column) -> Column:
    return F.to_json(value)


def in_domain(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def clamp_limit(limit: int | None, cap: int, default: int = 100) -> int:
    """Listing limits: non-positive or above the cap falls back to the default."""
    if limit is None or limit <= 0 or limit > cap:
        return default
    return limit


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, without a session-zone conversion."""
    days = F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return secs * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
