"""Support-operations and refund analytics expressed as Spark DataFrames."""

from tallyforge.session import build_session

__all__ = ["build_session"]
