"""Market-risk and portfolio analytics expressed as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
