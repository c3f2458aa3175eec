"""Streams.  Their stateful processors are pickled by value, as the operators are."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
