import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from concord import schemas as S
from concord.functions import columns as C
from concord.functions import conflict, fingerprint, providers, resilience, same_fields
from concord.functions.signature import key_pads, signature_ok
from concord.functions.resilience import backoff_seconds, error_kind, retryable, shortened

T0 = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("secret", ["k", "secret-t0", "x" * 64, "y" * 65, "ключ" * 30])
def test_signature_equals_python_hmac(spark, secret):
    body = json.dumps({"a": "ü", "b": [1, 2]})
    good = "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    headers = [good, good.upper().replace("SHA256", "sha256"), good[:-1], "sha256=00", good[7:], "md5=" + good[7:], None, "sha256=zz"]
    df = spark.createDataFrame([(secret, body, h) for h in headers], "s string, b string, h string")
    df = df.withColumn("pads", key_pads(F.col("s")))
    got = [r.ok for r in df.select(signature_ok(F.col("s"), F.col("pads"), F.col("b"), F.col("h")).alias("ok")).collect()]
    assert got == [True, True] + [False] * 6


def test_empty_secret_never_verifies(spark):
    body = "{}"
    good = "sha256=" + hmac.new(b"", body.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("", body, good)], "s string, b string, h string").withColumn("pads", key_pads(F.col("s")))
    assert df.select(signature_ok(F.col("s"), F.col("pads"), F.col("b"), F.col("h")).alias("ok")).first().ok is False


def test_fingerprint_text(spark):
    f = F.struct(*[F.lit(v).alias(n) for n, v in zip(S.FIELDS, ["A", "B", "a@b", "1", "C"])])
    want = hashlib.sha256(b"first_name=A|last_name=B|email=a@b|phone=1|company=C").hexdigest()
    assert one(spark, fingerprint(f)) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-05-06T07:08:09Z", dt.datetime(2024, 5, 6, 7, 8, 9)),
        ("2024-05-06T07:08:09.25Z", dt.datetime(2024, 5, 6, 7, 8, 9, 250000)),
        ("2024-05-06T07:08:09+02:30", dt.datetime(2024, 5, 6, 4, 38, 9)),
        ("2024-05-06T23:08:09-01:00", dt.datetime(2024, 5, 7, 0, 8, 9)),
        ("2024-05-06 07:08:09", None),
        ("2024-13-06T07:08:09Z", None),
        ("", None),
    ],
)
def test_rfc3339(spark, text, want):
    assert one(spark, C.parse_rfc3339(F.col("t")), t=text) == want


def test_same_fields_coerces_but_keeps_null_apart(spark):
    a = F.struct(F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.lit("e").alias("email"), F.lit(5550100).alias("phone"), F.lit("").alias("company"))
    b = F.struct(F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.lit("e").alias("email"), F.lit("5550100").alias("phone"), F.lit("").alias("company"))
    c = F.struct(F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.lit("e").alias("email"), F.lit("5550100").alias("phone"), F.lit(None).cast("string").alias("company"))
    assert one(spark, same_fields(a, b)) is True
    assert one(spark, same_fields(a, c)) is False


@pytest.mark.parametrize("name", ["salesforce", "hubspot"])
def test_adapter_round_trip_and_first_missing(spark, name):
    fields = F.struct(*[F.lit(v).alias(n) for n, v in zip(S.FIELDS, ["A", "B", "a@b", "1", "C"])])
    native = providers.denormalize(F.lit(name), fields)
    back = one(spark, providers.normalize(F.lit(name), native))
    assert tuple(back) == ("A", "B", "a@b", "1", "C")
    assert one(spark, native)["deleted"] == "false"
    gone = F.map_filter(native, lambda k, v: ~k.isin("last_name", "lastName", "email", "emailAddress"))
    want = "last_name" if name == "salesforce" else "lastName"
    assert one(spark, providers.missing_field(F.lit(name), gone)) == f"missing required field {want}"


def test_unknown_provider(spark):
    with pytest.raises(ValueError):
        providers.provider("nobody")
    assert one(spark, providers.is_known(F.lit("nobody"))) is False


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"id":"a","version":3,"deleted":true}', ("a", 3, True, None)),
        ('{"id":"a","version":"12","deleted":"true"}', ("a", 12, False, None)),
        ('{"id":"a","version":"v1"}', ("a", 0, False, None)),
        ('{"id":"a","version":2.9}', ("a", 2, False, None)),
        ('{"id":7}', ("", 0, False, "record missing id")),
        ('{"version":1}', ("", 1, False, "record missing id")),
    ],
)
def test_envelope(spark, raw, want):
    assert tuple(one(spark, providers.envelope(F.lit("salesforce"), F.col("r")), r=raw)) == want


H = dt.timedelta(hours=1)


@pytest.mark.parametrize(
    "strategy,occ_a,prio_a,occ_b,prio_b,side",
    [
        ("last_write_wins", T0, 100, T0 + H, 200, "b"),
        ("last_write_wins", T0 + H, 200, T0, 100, "a"),
        ("last_write_wins", T0, 200, T0, 100, "b"),
        ("last_write_wins", T0, 100, T0, 100, "a"),
        ("field_merge", T0, 100, T0 + H, 200, "b"),
        ("source_priority", T0 + H, 200, T0, 100, "b"),
        ("source_priority", T0, 100, T0 + H, 200, "a"),
        ("source_priority", T0, 100, T0 + H, 100, "b"),
        ("source_priority", T0, 100, T0, 100, "a"),
        ("manual", T0, 100, T0 + H, 100, ""),
        ("whatever", T0, 100, T0 + H, 1, "a"),
        # a missing time is before all others and equal to itself
        ("last_write_wins", None, 1, T0, 100, "b"),
        ("last_write_wins", T0, 100, None, 1, "a"),
        ("last_write_wins", None, 100, None, 1, "b"),
        ("field_merge", None, 100, None, 100, "a"),
        ("source_priority", None, 100, T0, 100, "b"),
    ],
)
def test_winning_side(spark, strategy, occ_a, prio_a, occ_b, prio_b, side):
    df = spark.createDataFrame([(strategy, occ_a, prio_a, occ_b, prio_b)], "s string, oa timestamp_ntz, pa int, ob timestamp_ntz, pb int")
    assert df.select(conflict.winning_side(*[F.col(c) for c in ("s", "oa", "pa", "ob", "pb")]).alias("x")).first().x == side


def test_effective_strategy(spark):
    assert one(spark, conflict.effective_strategy(F.lit("nope"))) == "last_write_wins"
    assert one(spark, conflict.effective_strategy(F.lit("manual"))) == "manual"


@pytest.mark.parametrize("code,kind", [(429, "RATE_LIMITED"), (401, "AUTHENTICATION"), (403, "AUTHENTICATION"), (404, "NOT_FOUND"), (400, "SCHEMA_ERROR"), (422, "SCHEMA_ERROR"), (409, "CONFLICT"), (500, "TRANSIENT"), (502, "TRANSIENT"), (503, "TRANSIENT"), (504, "TRANSIENT"), (418, "UNKNOWN"), (200, None), (204, None)])
def test_error_kind(spark, code, kind):
    assert one(spark, error_kind(F.lit(code))) == kind


def test_error_kind_of_broken_transport_and_body(spark):
    assert one(spark, error_kind(F.lit(None).cast("int"), transport_error=F.lit(True))) == "TRANSIENT"
    assert one(spark, error_kind(F.lit(200), decodable=F.lit(False))) == "SCHEMA_ERROR"


@pytest.mark.parametrize("kind,want", [("TRANSIENT", True), ("RATE_LIMITED", True), ("CONFLICT", True), ("NOT_FOUND", True), ("UNKNOWN", True), ("PERMANENT", False), ("AUTHENTICATION", False), ("SCHEMA_ERROR", False), ("SOMETHING", True)])
def test_retryable(spark, kind, want):
    assert one(spark, retryable(F.lit(kind))) is want


@pytest.mark.parametrize("n,fraction,want", [(1, 0.5, 1.0), (0, 0.5, 1.0), (-3, 0.5, 1.0), (2, 0.5, 2.0), (5, 0.5, 16.0), (7, 0.0, 42.0), (7, 1.0, 60.0), (80, 0.5, 60.0), (3, 0.0, 2.8), (3, 1.0, 5.2)])
def test_backoff(spark, n, fraction, want):
    assert one(spark, backoff_seconds(F.lit(n), F.lit(fraction))) == pytest.approx(want)


def test_backoff_defaults_and_bounds(spark):
    df = spark.range(1, 200).select(backoff_seconds(F.col("id"), resilience.hash_fraction(F.col("id"), F.lit(1)), base=0, cap=-1).alias("d"))
    lo, hi = df.agg(F.min("d"), F.max("d")).first()
    assert 0.7 <= lo and hi <= 60.0


@pytest.mark.parametrize("delay,hint,want", [(10.0, 0, 10.0), (10.0, 2, 2.0), (2.0, 10, 2.0), (90.0, 0, 60.0)])
def test_retry_after_only_shortens(spark, delay, hint, want):
    assert one(spark, shortened(F.lit(delay), F.lit(hint))) == want


def test_decode_snapshot(spark):
    assert one(spark, C.decode_snapshot(F.lit('{"a":"1"}'))) == {"a": "1"}
    assert one(spark, C.decode_snapshot(F.lit(" nonsense "))) == {"raw": "nonsense"}


@pytest.mark.parametrize("limit,cap,want", [(None, 1000, 100), (0, 1000, 100), (-1, 500, 100), (501, 500, 100), (500, 500, 500), (7, 1000, 7)])
def test_clamp(limit, cap, want):
    assert C.clamp_limit(limit, cap) == want
