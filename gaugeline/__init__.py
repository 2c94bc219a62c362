"""gaugeline: sensor time series on Spark (cleaning, gap filling, quality control, features, evaluation)."""

import sys

from pyspark import cloudpickle

from gaugeline.schema import SeriesSchema
from gaugeline.session import build_session, checkpointed

# Task functions travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SeriesSchema", "build_session", "checkpointed"]
