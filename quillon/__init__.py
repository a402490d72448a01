"""quillon: a PySpark-native document analytics engine."""

from quillon._ship import by_value

by_value()
