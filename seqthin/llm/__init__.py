"""Operators of a training-data pipeline.

Functions that run in Python workers travel with their tasks, as in the package above.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
