"""Tabular preparation, profiling, modelling and lineage on PySpark."""
