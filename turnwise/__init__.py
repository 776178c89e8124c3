"""Turnwise: conversation-compliance analytics and corpus curation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors get the library's helpers with each task and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
