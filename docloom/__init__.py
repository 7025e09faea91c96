"""docloom: document-operations analytics as Spark DataFrame jobs.

Sub-packages
    sources    readers, the markup tokeniser and the sinks
    functions  Column-level helpers (URLs, text, locale numbers, units)
    operators  DataFrame -> DataFrame operators
    streaming  Structured Streaming counterparts
    plans      the registered queries and their SQL oracles
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
