"""Field-level conflict detection and resolution as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.columns import same_value
from concord.schemas import CONFLICT_DDL, FIELDS

# A strategy answers "does the incoming side win?" from the two sides' times and priorities.
# Priorities are ranks: the lower number is the stronger source.
Strategy = Callable[[Column, Column, Column, Column], Column]


def _latest(occ_a: Column, prio_a: Column, occ_b: Column, prio_b: Column) -> Column:
    return (occ_b > occ_a) | ((occ_b == occ_a) & (prio_b < prio_a))


def _ranked(occ_a: Column, prio_a: Column, occ_b: Column, prio_b: Column) -> Column:
    return (prio_b < prio_a) | ((prio_b == prio_a) & (occ_b > occ_a))


AUTOMATIC: dict[str, Strategy] = {
    "last_write_wins": _latest,
    "field_merge": _latest,
    "source_priority": _ranked,
}
MANUAL = "manual"


def effective_strategy(strategy: Column) -> Column:
    """The strategy a merge applies: anything unknown acts as last_write_wins."""
    return F.when(strategy.isin(*AUTOMATIC, MANUAL), strategy).otherwise(F.lit("last_write_wins"))


def _time(occurred_at: Column) -> Column:
    """A missing time is earlier than any other and equal to another missing one."""
    return F.coalesce(occurred_at, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def winning_side(strategy: Column, occ_a: Column, prio_a: Column, occ_b: Column, prio_b: Column) -> Column:
    """'a' keeps the stored value, 'b' takes the incoming one, '' leaves it to an operator."""
    occ_a, occ_b = _time(occ_a), _time(occ_b)
    out = F.when(strategy == MANUAL, F.lit(""))
    for name, incoming_wins in AUTOMATIC.items():
        verdict = F.coalesce(incoming_wins(occ_a, prio_a, occ_b, prio_b), F.lit(False))
        out = out.when(strategy == name, F.when(verdict, F.lit("b")).otherwise(F.lit("a")))
    return out.otherwise(F.lit("a"))


def clashes(name: str, stored: Column, prov: Column, incoming: Column, source: Column) -> Column:
    """A field clashes when another source wrote it last and the value differs."""
    writer = prov[name]["source"]
    return F.coalesce(writer.isNotNull() & (writer != source) & ~same_value(stored[name], incoming[name]), F.lit(False))


def detect(
    stored: Column, prov: Column, incoming: Column, source: Column, version: Column, occurred_at: Column, priority: Column
) -> Column:
    """Array of clashing fields with both sides, ordered by field name."""
    sides = [
        F.when(
            clashes(name, stored, prov, incoming, source),
            F.struct(
                F.lit(name).alias("field"),
                prov[name]["source"].alias("source_a"),
                prov[name]["version"].alias("version_a"),
                prov[name]["occurred_at"].alias("occurred_at_a"),
                prov[name]["priority"].alias("priority_a"),
                stored[name].alias("value_a"),
                source.alias("source_b"),
                version.alias("version_b"),
                occurred_at.alias("occurred_at_b"),
                priority.alias("priority_b"),
                incoming[name].alias("value_b"),
            ).cast(CONFLICT_DDL),
        )
        for name in sorted(FIELDS)
    ]
    return F.filter(F.array(*sides), lambda c: c.isNotNull())


def takes_incoming(
    name: str, strategy: Column, stored: Column, prov: Column, incoming: Column, source: Column, occurred_at: Column, priority: Column
) -> Column:
    """Whether the merged field takes the incoming value (no clash, or the incoming side wins).
    `strategy` is an effective one."""
    side = winning_side(strategy, prov[name]["occurred_at"], prov[name]["priority"], occurred_at, priority)
    return ~clashes(name, stored, prov, incoming, source) | (side == "b")


def merge_fields(stored: Column, incoming: Column, takes: Column) -> Column:
    return F.struct(*[F.when(takes[n], incoming[n]).otherwise(stored[n]).alias(n) for n in FIELDS])


def merge_provenance(prov: Column, takes: Column, source: Column, version: Column, occurred_at: Column, priority: Callable[[str], Column]) -> Column:
    def writer(n: str) -> Column:
        return F.struct(
            source.alias("source"), version.alias("version"), occurred_at.alias("occurred_at"), priority(n).alias("priority")
        )

    return F.struct(*[F.when(takes[n], writer(n)).otherwise(prov[n]).alias(n) for n in FIELDS])
