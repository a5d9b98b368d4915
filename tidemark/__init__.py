"""A Spark-first engine for market bars, trade-rule research and training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions that go to executors travel by value: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
