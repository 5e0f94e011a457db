"""Post-corpus analytics on Spark: every operator is DataFrame -> DataFrame."""

from postmine.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
