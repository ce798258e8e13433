"""cohortspark: analysis of labelled samples that come from many studies, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to the Python workers travel with their code, so the executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
