"""Replay and research over order-level market tapes, as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
