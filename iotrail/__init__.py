"""iotrail: storage I/O trace analytics expressed as Spark DataFrames."""

from iotrail.session import get_spark, stage, workspace

__all__ = ["get_spark", "stage", "workspace"]
