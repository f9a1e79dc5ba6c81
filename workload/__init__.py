"""Every operator as a query over the given tables, with the SQL that checks it."""

from workload import lineage, modelling, prepare, profiling, synthesis  # noqa: F401
from workload.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
