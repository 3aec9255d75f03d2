"""Data side of language-model post-training as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the task, so executors do not
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
