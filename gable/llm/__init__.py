"""Operators of a training-data pipeline over a table of documents.

Nothing outside this package imports it. Functions that run in Spark's Python
workers are sent by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
