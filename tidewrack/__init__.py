"""Tidewrack: session analytics over agent transcripts and text corpora, written as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Arrow batches travel to the executors whole, so that those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
