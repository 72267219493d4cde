"""Verification of synthetic tables and its evidence, on Spark.

Functions and stateful processors travel to the Python workers by value, so
executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
