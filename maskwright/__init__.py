"""Finds credentials in large text collections and rewrites them safely.

Tasks get the functions of this package by value, so executors need no copy of it on
their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
