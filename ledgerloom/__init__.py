"""ledgerloom: a PySpark-native engine that reconciles competing events.

The library builds DataFrame plans only; nothing here starts a session.
Functions that run in Python workers are pickled by value, so executors do
not need the package on their own path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
