"""Operators of a training-data pipeline: one module per operator, queries in ``catalog``."""

import sys

from pyspark import cloudpickle

# tasks get these functions by value, so workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
