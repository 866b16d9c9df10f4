"""tarn: a document and vector lake expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from tarn.session import checkpoint_dir, get_session

# Functions that run in Python workers travel by value: the executors need
# numpy, pandas and Arrow, but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint_dir", "get_session"]
