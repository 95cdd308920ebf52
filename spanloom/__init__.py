"""spanloom: log and trace analytics as Spark DataFrame jobs."""

from spanloom.session import build_session, prepare

__all__ = ["build_session", "prepare"]
