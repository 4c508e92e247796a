"""Operators for preparing language-model training data (see README).

Functions that run in tasks travel with the task, so executors need not have
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
