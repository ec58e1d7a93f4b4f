"""Operators: DataFrames in, DataFrames out.

The few functions that run inside Python tasks travel with their code, so
executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
