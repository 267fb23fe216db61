"""Operators for building training corpora: dedup, filtering, scoring, mixing, encoding."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
