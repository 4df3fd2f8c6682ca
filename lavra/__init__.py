"""lavra: event-log analytics on Spark DataFrames."""

from lavra.session import get_spark

__all__ = ["get_spark"]
