"""Scans and sinks.  Python functions that run in tasks are pickled by value, so
executors need pyarrow, pandas and numpy but not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
