"""Preparation operators: ``fit`` reads the data once, ``transform`` stays lazy."""
