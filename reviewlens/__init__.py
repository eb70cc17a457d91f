"""Aspect-sentiment analytics for review tables, written for Spark."""

import sys

from pyspark import cloudpickle

from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS, SENTIMENTS

__all__ = ["ANNOTATION_ASPECTS", "ASPECTS", "SENTIMENTS"]

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
