"""Codecs in Python: PNG (with APNG), GIF, JPEG, TIFF and BMP, and FLAC to read. Other formats have no decoder here and fail closed."""

from __future__ import annotations


class Undecodable(ValueError):
    """The bytes can't be decoded whole."""
