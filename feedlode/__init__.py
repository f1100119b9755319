"""feedlode: mining posts, reviews and transcripts for recurring pain points on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent along with the job, so that executors need
# not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
