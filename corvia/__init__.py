"""Corvia: legal-text analytics and training-data operators expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their task; the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
