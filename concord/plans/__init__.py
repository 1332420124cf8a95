from concord.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
