"""Provider adapters as data: a mapping per provider, turned into column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.columns import blank, coerce, parse_rfc3339
from concord.schemas import ENTITY_TYPE, FIELDS


@dataclass(frozen=True)
class Provider:
    name: str
    native_type: str
    id_key: str
    time_key: str
    names: dict[str, str]  # canonical field -> provider field
    required: tuple[str, ...]  # provider field names, in the order they are checked
    canonical_type: str = ENTITY_TYPE
    # Optional user hook, applied to each normalized field: (canonical name, value) -> value.
    refine: Callable[[str, Column], Column] | None = field(default=None, compare=False)


_REGISTRY: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    _REGISTRY[provider.name] = provider
    return provider


def provider(name: str) -> Provider:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown provider {name!r}") from None


def provider_names() -> list[str]:
    return sorted(_REGISTRY)


# The field names the two built-in providers use.
register(
    Provider(
        name="salesforce",
        native_type="customer",
        id_key="id",
        time_key="updated_at",
        names={
            "first_name": "first_name",
            "last_name": "last_name",
            "email": "email",
            "phone": "phone",
            "company": "company",
        },
        required=("first_name", "last_name", "email"),
    )
)
register(
    Provider(
        name="hubspot",
        native_type="contact",
        id_key="contact_id",
        time_key="modifiedAt",
        names={
            "first_name": "firstName",
            "last_name": "lastName",
            "email": "emailAddress",
            "phone": "phoneNumber",
            "company": "organization",
        },
        required=("firstName", "lastName", "emailAddress"),
    )
)


def per_provider(source: Column, build: Callable[[Provider], Column]) -> Column:
    """CASE over the registry; null for a source without an adapter."""
    out: Column | None = None
    for name in provider_names():
        value = build(_REGISTRY[name])
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out


def is_known(source: Column) -> Column:
    return F.coalesce(source.isin(provider_names()), F.lit(False))


def canonical_type(source: Column) -> Column:
    return per_provider(source, lambda p: F.lit(p.canonical_type))


def missing_field(source: Column, data: Column) -> Column:
    """Error text naming the first required field that is absent or empty; null when valid."""
    return per_provider(
        source,
        lambda p: F.coalesce(
            *[
                F.when(blank(F.try_element_at(data, F.lit(key)).cast("string")), F.lit(f"missing required field {key}"))
                for key in p.required
            ]
        ),
    )


def normalize(source: Column, data: Column) -> Column:
    """Provider map to the canonical field struct."""

    def one(name: str) -> Column:
        def build(p: Provider) -> Column:
            value = coerce(F.try_element_at(data, F.lit(p.names[name])))
            return p.refine(name, value) if p.refine else value

        return per_provider(source, build).alias(name)

    return F.struct(*[one(name) for name in FIELDS])


def updated_at(source: Column, data: Column) -> Column:
    return per_provider(source, lambda p: parse_rfc3339(F.try_element_at(data, F.lit(p.time_key))))


def denormalize(target: Column, fields: Column, deleted: Column | None = None) -> Column:
    """Canonical field struct to a provider map, including the `deleted` flag."""
    flag = (deleted if deleted is not None else F.lit(False)).cast("string")

    def build(p: Provider) -> Column:
        pairs: list[Column] = []
        for name in FIELDS:
            pairs += [F.lit(p.names[name]), coerce(fields[name])]
        return F.create_map(*pairs, F.lit("deleted"), flag)

    return per_provider(target, build)


def envelope(source: Column, raw: Column) -> Column:
    """id / version / deleted of a raw provider record given as JSON text.

    Version may be a number or numeric text (else 0); `deleted` counts only as a JSON boolean;
    a missing id is a schema error.
    """

    def build(p: Provider) -> Column:
        text_id = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{p.id_key}", "variant")) == "STRING",
                         F.try_variant_get(F.try_parse_json(raw), f"$.{p.id_key}", "string"))
        return F.coalesce(text_id, F.lit(""))

    variant = F.try_parse_json(raw)
    version = F.try_variant_get(variant, "$.version", "variant")
    kind = F.schema_of_variant(version)
    number = F.when(
        kind == "STRING",
        F.when(
            F.try_variant_get(variant, "$.version", "string").rlike(r"^[+-]?\d+$"),
            F.try_variant_get(variant, "$.version", "string").try_cast("bigint"),
        ),
    ).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(variant, "$.version", "double").try_cast("bigint"))
    deleted = F.when(
        F.schema_of_variant(F.try_variant_get(variant, "$.deleted", "variant")) == "BOOLEAN",
        F.try_variant_get(variant, "$.deleted", "boolean"),
    )
    ident = per_provider(source, build)
    return F.struct(
        F.coalesce(ident, F.lit("")).alias("id"),
        F.coalesce(number, F.lit(0)).cast("bigint").alias("source_version"),
        F.coalesce(deleted, F.lit(False)).alias("deleted"),
        F.when(F.coalesce(ident, F.lit("")) == "", per_provider(source, lambda p: F.lit(f"record missing {p.id_key}"))).alias("error"),
    )
