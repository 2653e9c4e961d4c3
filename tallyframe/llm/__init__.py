"""Operators for preparing text corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
