"""Bring stored sessions back."""

from pyspark.sql import DataFrame

from casefuse.operators.documents import restore_warnings, unreachable_documents
from casefuse.sources.history import load_sessions


def restore_sessions(snapshots: DataFrame, stored: DataFrame, listing: DataFrame):
    """Latest sessions, their documents that still open, and one warning line per case."""
    lost = unreachable_documents(stored, listing)
    kept = stored.join(lost.select("case_id", "uri"), ["case_id", "uri"], "left_anti")
    return load_sessions(snapshots), kept, restore_warnings(stored, listing)
