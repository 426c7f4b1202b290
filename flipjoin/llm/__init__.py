"""Operators for preparing training data: deduplication, scoring, packing, formatting.

Nothing else in the library imports this subpackage.  Its functions are sent to
Python workers by value, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
