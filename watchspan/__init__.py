"""Log detection and correlation as PySpark DataFrame jobs."""

from watchspan.schema import LEVELS
from watchspan.session import build_session, stable_storage

__all__ = ["LEVELS", "build_session", "stable_storage"]
