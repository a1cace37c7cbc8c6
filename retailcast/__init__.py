"""Demand analytics over many daily series, written for Spark DataFrames."""

import sys

from pyspark import cloudpickle

KEYS = ("store_nbr", "family")
DATE = "date"
TARGET = "sales"

# functions of this package travel to the Python workers by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DATE", "KEYS", "TARGET"]
