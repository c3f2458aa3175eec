"""Operators over commit rows, panels and fits.

Their few Python functions are pickled by value, so executors need numpy,
pandas and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
