"""Foliant: a PySpark engine for office documents, HTML and text corpora."""

import sys

from pyspark import cloudpickle

# executors get this package's functions with the job; it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
