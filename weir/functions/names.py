"""File names, extensions, MIME types and kinds as column expressions.

Nulls: an unknown name, extension, type or kind is null, never an empty string (but `a.` has the empty extension).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Kinds of extensions.
KIND_OF_EXTENSION = {
    "image": ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"),
    "animated_image": ("apng",),
    "gif": ("gif",),
    "video": ("mp4", "mov", "avi", "mkv", "webm"),
    "audio": ("mp3", "wav", "flac", "aac", "m4a", "ogg", "oga", "opus", "wma", "amr", "aiff", "alac"),
    "other": ("pdf", "txt", "csv", "json", "xml", "doc", "docx", "zip", "7z"),
}
# MIME types of extensions.
MIME_OF_EXTENSION = {
    "image/png": ("png", "apng"),
    "image/jpeg": ("jpg", "jpeg"),
    "image/bmp": ("bmp",),
    "image/tiff": ("tif", "tiff"),
    "image/webp": ("webp",),
    "image/gif": ("gif",),
    "application/mp4": ("mp4", "m4a"),
    "video/quicktime": ("mov",),
    "video/x-msvideo": ("avi",),
    "video/matroska": ("mkv",),
    "video/webm": ("webm",),
    "audio/mpeg": ("mp3",),
    "audio/wav": ("wav",),
    "audio/flac": ("flac",),
    "audio/aac": ("aac",),
    "audio/ogg": ("ogg", "oga", "opus"),
    "audio/amr": ("amr",),
    "audio/aiff": ("aif", "aiff"),
    "application/pdf": ("pdf",),
    "application/zip": ("zip",),
    "application/x-7z-compressed": ("7z",),
    "text/plain": ("txt", "csv"),
    "application/json": ("json",),
    "application/xml": ("xml",),
}
# Names that mean the same MIME type.
MIME_ALIASES = {
    "image/jpeg": ("image/jpg", "image/pjpeg"),
    "image/png": ("image/x-png", "image/apng"),
    "image/bmp": ("image/x-ms-bmp",),
    "audio/wav": ("audio/x-wav", "audio/wave", "audio/vnd.wave"),
    "audio/flac": ("audio/x-flac",),
    "application/mp4": ("audio/m4a", "audio/x-m4a", "audio/mp4", "video/mp4", "video/x-m4v"),
    "audio/aiff": ("audio/x-aiff",),
    "audio/ogg": ("application/ogg", "audio/opus"),
    "video/matroska": ("video/x-matroska",),
}
# Extensions that are dangerous before the last one.
DANGEROUS = ("exe", "dll", "bat", "cmd", "msi", "scr", "vbs", "vbe", "ps1", "psc1", "jar", "apk", "com", "pif", "hta", "cpl", "wsf", "wsh")
# Extensions of released files.
EXTENSION_OF_MIME = {
    "png": ("image/png",),
    "jpg": ("image/jpeg",),
    "webp": ("image/webp",),
    "gif": ("image/gif",),
    "mp4": ("video/mp4", "application/mp4"),
    "webm": ("video/webm",),
    "mp3": ("audio/mpeg", "audio/mp3"),
    "wav": ("audio/wav", "audio/x-wav", "audio/wave"),
    "flac": ("audio/flac", "audio/x-flac"),
    "ogg": ("audio/ogg", "audio/opus"),
    "m4a": ("audio/mp4", "audio/x-m4a"),
    "aac": ("audio/aac",),
}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def looked_up(c: Column, table: dict[str, tuple[str, ...]], default: Column | None = None) -> Column:
    """The key whose values hold c, else the default (null). The table is one literal of the plan."""
    pairs = F.create_map(*[F.lit(x) for key, values in table.items() for value in values for x in (value, key)])
    found = F.when(c.isNotNull(), F.try_element_at(pairs, F.coalesce(c, F.lit(""))))
    return found if default is None else F.coalesce(found, default)


def base_name(name: Column) -> Column:
    """The last component of a path; trailing slashes and `/.` don't count."""
    return F.regexp_extract(F.regexp_replace(name, r"(/+\.?)+$", ""), r"(?s)([^/]*)$", 1)


def extension(name: Column) -> Column:
    """What stands behind the last dot, lower-cased; a leading dot alone makes none."""
    base = base_name(name)
    found = (base != "..") & base.rlike(r"(?s)^.+\.[^.]*$")
    return F.when(found, ascii_lower(F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1)))


def kind_of_extension(ext: Column) -> Column:
    return looked_up(ext, KIND_OF_EXTENSION)


def mime_of_extension(ext: Column) -> Column:
    return looked_up(ext, MIME_OF_EXTENSION)


def kind_from_name(name: Column) -> Column:
    return kind_of_extension(extension(name))


def mime_from_name(name: Column) -> Column:
    return mime_of_extension(extension(name))


def kind_from_mime(mime: Column) -> Column:
    m = ascii_lower(mime)
    return (
        F.when(m.startswith("image/gif"), "gif")
        .when(m.startswith("image/svg"), "other")
        .when(m.startswith("image/"), "image")
        .when(m.startswith("video/"), "video")
        .when(m.startswith("audio/"), "audio")
        .when(m.startswith("application/") | m.startswith("text/"), "other")
    )


def normal_mime(mime: Column) -> Column:
    plain = ascii_lower(F.regexp_replace(F.substring_index(mime, ";", 1), r"(?U)^\s+|\s+$", ""))
    return looked_up(plain, MIME_ALIASES, plain)


def same_mime(a: Column, b: Column) -> Column:
    return normal_mime(a) == normal_mime(b)


def compatible_kinds(a: Column, b: Column) -> Column:
    still = ("image", "animated_image")
    return (a == b) | (a.isin(*still) & b.isin(*still))


def double_extension(name: Column) -> Column:
    """Whether a dangerous extension stands before the last one; false without a name."""
    parts = F.split(name, r"\.")
    before = F.when(F.size(parts) >= 3, ascii_lower(F.element_at(parts, -2)))
    return F.coalesce(before.isin(*DANGEROUS), F.lit(False))


def kind_label(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("unknown"))


def summary_of_failure(message: Column) -> Column:
    """First line, at most 80 characters of printable ASCII (others as ?), with an ellipsis if cut."""
    line = F.regexp_extract(F.coalesce(message, F.lit("")), r"^([^\r\n]*)", 1)
    plain = F.regexp_replace(line, r"[^\x20-\x7E]", "?")
    cut = F.when(F.length(plain) > 80, F.concat(F.substring(plain, 1, 80), F.lit("…"))).otherwise(plain)
    return F.when(message.isNull(), "panic with non-string payload").when(cut == "", "empty panic message").otherwise(cut)


# The types that count as sound in an encoder's output, and the ones that are the same.
AUDIO_TYPES = ("audio/mpeg", "audio/aac", "audio/opus", "audio/flac", "audio/wav", "audio/x-wav", "audio/ogg")
CANONICAL_AUDIO = {
    "audio/opus": ("audio/ogg", "audio/opus"),
    "audio/wav": ("audio/x-wav", "audio/wav"),
    "audio/mpeg": ("audio/mpeg",),
    "audio/aac": ("audio/aac",),
    "audio/flac": ("audio/flac",),
}
UNKNOWN_AUDIO = "audio/unknown"


def is_audio_type(mime: Column) -> Column:
    return F.coalesce(mime.isin(*AUDIO_TYPES), F.lit(False))


def canonical_audio(mime: Column) -> Column:
    """One name for each kind of sound; others are unknown."""
    return F.coalesce(looked_up(mime, CANONICAL_AUDIO), F.lit(UNKNOWN_AUDIO))


def canonical_audio_of(mime: str) -> str:
    """The same for a value at hand."""
    return next((name for name, same in CANONICAL_AUDIO.items() if mime in same), UNKNOWN_AUDIO)
