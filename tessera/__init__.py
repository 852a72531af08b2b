"""Governance of material master data on Spark: normalisation, quality rules, duplicate candidates, decisions, reviews
and append-only event logs, all as DataFrame and Column functions.

Worker functions are pickled by value, so that executors need not find this package on their own path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
