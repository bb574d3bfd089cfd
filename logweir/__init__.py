"""logweir: log analytics on PySpark, DataFrame in and DataFrame out.

Functions that run in Python workers are sent by value, so executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
