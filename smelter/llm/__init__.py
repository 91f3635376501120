"""Operators for preparing training text at scale; nothing else in the library imports them.

Functions that run on executors are shipped whole, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
