"""tidelex: a PySpark engine for measuring how language shifts over time, and for preparing text corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
