"""Operators for building training data at scale.

One module per operator; ``queries.py`` registers the thin ``opN_<name>``
queries.  Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value: a cluster needs no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
