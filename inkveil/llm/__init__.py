"""Operators for preparing training data; nothing else in the library imports them.

Functions that run inside tasks travel with their code, so executors need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
