"""Operators for preparing training data; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions of this subpackage with them, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
