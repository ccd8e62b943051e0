"""Spark-native report extraction and prospectivity analytics."""

from orestrata.session import build_session, read_table

__all__ = ["build_session", "read_table"]
