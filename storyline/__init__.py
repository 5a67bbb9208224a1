"""Storyline: feeds of short documents to ranked stories, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Spark tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
