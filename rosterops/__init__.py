"""Roster, training and manual analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
