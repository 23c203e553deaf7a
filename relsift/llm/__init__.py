"""Operators for training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL. Every operator selects the columns it works on first, so
extra columns of any name in its input neither clash nor cost anything.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
