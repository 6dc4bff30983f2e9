"""spanloom: text and span analytics as PySpark DataFrame transformations."""

from .session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
