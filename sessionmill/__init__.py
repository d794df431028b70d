"""Spark jobs that distil agent session transcripts into small knowledge tables.

Functions for Python workers travel by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
