"""Pipelines over streaming frames."""

from .apply import run_stream, streamable

__all__ = ["run_stream", "streamable"]
