"""beatwire: monitoring of public-safety incidents in news text, on Spark."""

from beatwire.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
