"""Spark jobs that turn landed job-board data into a clean, scored and linked postings table."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
