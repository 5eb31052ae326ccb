"""Operators of a training-data pipeline: scoring, filtering, deduplication,
extraction, encoding and packing of large text collections.

Nothing else in the library imports this package. Code that runs inside tasks
travels with them, so executors need numpy, pyarrow and the tokenizer libraries
but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
