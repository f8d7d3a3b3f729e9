"""Posting analytics on Spark: sources, operators, functions and plans as DataFrame code."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
