"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Its functions travel to executors by value: the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
