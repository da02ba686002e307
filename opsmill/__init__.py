"""Data-operations work on tables and streams, written as DataFrame functions."""

__version__ = "0.1.0"
