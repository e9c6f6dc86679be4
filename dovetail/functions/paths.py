"""Parts of POSIX paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ext(path: Column) -> Column:
    """Extension with its dot, in its own case; a name that only begins with dots has none."""
    return F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext(path)))


def components(path: Column) -> Column:
    """The directories of a path, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def ancestors(directory: Column) -> Column:
    """A directory and all above it, outermost first."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether ``path`` is one of ``prefixes`` or lies below one."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | F.startswith(path, F.lit(p + "/"))
    return out
