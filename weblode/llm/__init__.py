"""Operators for preparing training text.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# What tasks run travels with the plan, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
