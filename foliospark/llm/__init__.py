"""Operators for preparing training data: filters, deduplication, classification, packing and tokens.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of these modules travel with the task, so that executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
