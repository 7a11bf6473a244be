"""Generation-run analytics as DataFrame and Structured Streaming operators."""

from runlens.session import build_session, materialize, shared_dir

__all__ = ["build_session", "materialize", "shared_dir"]
