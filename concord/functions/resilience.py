"""Failure classification and retry timing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result code -> error kind, and which kinds are never retried.
KIND_BY_CODE = {
    429: "RATE_LIMITED",
    401: "AUTHENTICATION",
    403: "AUTHENTICATION",
    404: "NOT_FOUND",
    400: "SCHEMA_ERROR",
    422: "SCHEMA_ERROR",
    409: "CONFLICT",
    500: "TRANSIENT",
    502: "TRANSIENT",
    503: "TRANSIENT",
    504: "TRANSIENT",
}
PERMANENT_KINDS = ("PERMANENT", "AUTHENTICATION", "SCHEMA_ERROR")
BASE_SECONDS = 1.0
MAX_SECONDS = 60.0


def error_kind(code: Column, transport_error: Column | None = None, decodable: Column | None = None) -> Column:
    """Kind of a write result; null for success.

    A transport error has no code. A success whose body cannot be decoded is a schema error.
    """
    broken = F.coalesce(transport_error, F.lit(False)) if transport_error is not None else F.lit(False)
    readable = F.coalesce(decodable, F.lit(True)) if decodable is not None else F.lit(True)
    out = F.when(broken, F.lit("TRANSIENT"))
    out = out.when(code.between(200, 299), F.when(~readable, F.lit("SCHEMA_ERROR")))
    for kind in dict.fromkeys(KIND_BY_CODE.values()):
        out = out.when(code.isin([c for c, k in KIND_BY_CODE.items() if k == kind]), F.lit(kind))
    return out.otherwise(F.lit("UNKNOWN"))


def retry_after(code: Column, header: Column) -> Column:
    """Whole seconds of a Retry-After hint, honoured only for rate limits."""
    return F.when(code == 429, F.coalesce(header.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def retryable(kind: Column) -> Column:
    return ~F.coalesce(kind.isin(*PERMANENT_KINDS), F.lit(False))


def hash_fraction(*keys: Column) -> Column:
    """Reproducible fraction in [0, 1) used as jitter, so that a replay schedules the same times."""
    return F.pmod(F.xxhash64(*keys), F.lit(10000)) / F.lit(10000.0)


def backoff_seconds(failures: Column, fraction: Column, base: float = BASE_SECONDS, cap: float = MAX_SECONDS) -> Column:
    """base * 2^(n-1), capped, times a jitter factor in [0.7, 1.3], capped again."""
    base = base if base > 0 else BASE_SECONDS
    cap = cap if cap > 0 else MAX_SECONDS
    n = F.greatest(failures.cast("int"), F.lit(1))
    # Powers above 62 no longer fit; they are over any cap anyway.
    step = F.when(n > 62, F.lit(cap)).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), (n - 1).cast("double")), F.lit(cap)))
    return F.least(step * (F.lit(0.7) + fraction * F.lit(0.6)), F.lit(cap))


def shortened(delay: Column, hint: Column, cap: float = MAX_SECONDS) -> Column:
    """A Retry-After hint may only shorten the delay."""
    return F.least(F.when((hint > 0) & (hint < delay), hint.cast("double")).otherwise(delay), F.lit(cap))


def after_seconds(at: Column, seconds: Column) -> Column:
    return at + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
