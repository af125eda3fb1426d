"""Container walkers: bytes in, bytes without metadata out. Plain Python, no Spark.

A walker returns None for input that isn't its format, a Cleaned for a rebuilt one, and raises Malformed otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass


class Malformed(ValueError):
    """kind: the error kind that the pipeline reports."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Cleaned:
    data: bytes
    mime: str
    stripped: int = 0
    stripped_bytes: int = 0
    note: str = ""
