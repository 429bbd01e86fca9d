"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
