"""Behavioural security analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the few Arrow functions to executors by value: clusters need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
