"""Operators for large text corpora. Nothing outside this folder and `corpus_pipeline.py` imports them.

Their functions travel to executors by value, so those need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
