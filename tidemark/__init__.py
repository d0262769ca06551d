"""Snapshot analytics and corpus preparation on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
