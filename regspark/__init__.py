"""regspark: regulation-corpus, retrieval and parcel analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the workers with the query, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
