"""Client-event analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``); every scalar function is ``Column -> Column``.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from clienttrace.spec import EventSpec
from clienttrace.session import build_session, shared_folder

__all__ = ["EventSpec", "build_session", "shared_folder"]

# Functions run in tasks travel with their code, so executors need no copy of
# this package on their path.
register_pickle_by_value(sys.modules[__name__])
