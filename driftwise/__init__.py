"""Replica auditing and large-scale record processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so that executors needn't have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
