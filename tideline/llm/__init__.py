"""Operators that prepare text and vectors for model training.

Functions that run on executors travel by value, so a cluster needs no copy of
this package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
