"""Tenant isolation for reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows of one tenant; no tenant means no rows."""
    if tenant_id is None or tenant_id == "":
        return df.where(F.lit(False))
    return df.where(F.col("tenant_id") == tenant_id)


class CrossTenantWrite(ValueError):
    pass


def foreign_rows(df: DataFrame, tenant_id: str) -> DataFrame:
    return df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant_id)))


def guard_write(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """The frame itself if every row belongs to the tenant; raises otherwise."""
    if not tenant_id or foreign_rows(df, tenant_id).limit(1).count():
        raise CrossTenantWrite(f"rows outside tenant {tenant_id!r}")
    return df
