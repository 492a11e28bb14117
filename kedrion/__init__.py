"""kedrion: a Spark-native engine for retrieval over document ontologies."""

from kedrion.session import build_session, shared_dir, staged

__all__ = ["build_session", "shared_dir", "staged"]
