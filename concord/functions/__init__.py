from concord.functions.columns import (
    coerce,
    compose_id,
    fingerprint,
    let,
    same_fields,
    same_value,
)

__all__ = ["coerce", "compose_id", "fingerprint", "let", "same_fields", "same_value"]
