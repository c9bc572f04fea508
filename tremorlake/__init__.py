"""Spark-native analytics for geophysical event catalogues, sensor streams and report corpora.

Functions that run in Python workers travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
