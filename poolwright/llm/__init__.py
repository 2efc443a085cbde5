"""Operators for building text-training corpora on Spark.

Nothing else in the library imports this subpackage.  Code that runs in Python
workers is shipped by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
