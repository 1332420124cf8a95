"""Spark-native record synchronisation and reconciliation."""

from concord.session import build_session

__all__ = ["build_session"]
