"""Ship this library's functions to executors by value, so that a cluster needs no installed copy."""

import sys

from pyspark import cloudpickle


def by_value() -> None:
    cloudpickle.register_pickle_by_value(sys.modules["quillon"])
