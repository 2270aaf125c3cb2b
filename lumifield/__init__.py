"""lumifield: multi-cycle fluorescence images as Spark tables."""

import sys

from pyspark import cloudpickle

from lumifield.session import build_session

# functions sent to executors travel with their code, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
