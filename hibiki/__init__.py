"""Bulk retrieval, enrichment and evaluation of customer-service requests on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code along: the package is needed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
