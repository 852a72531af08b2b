"""Operators of a large training-data pipeline.

Their worker functions are pickled by value, so that executors need not find this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
