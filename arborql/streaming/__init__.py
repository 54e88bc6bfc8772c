"""Checks of files as they arrive."""

from .check import check_stream

__all__ = ["check_stream"]
