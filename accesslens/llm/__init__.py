"""Operators for preparing training data; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors themselves; the executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
