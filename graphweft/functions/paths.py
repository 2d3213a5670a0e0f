"""Predicates over paths, names and node ids, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphweft.operators.vocabulary import EXCLUDED_MARKERS, TEST_PREFIX, TEST_SUFFIXES


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The directory of a path; `.` where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike("(" + "|".join(map(re.escape, TEST_SUFFIXES)) + r")\z") | base_name(low).startswith(TEST_PREFIX)


def is_excluded(path: Column) -> Column:
    """Test, vendored, mock and generated paths."""
    low = F.lower(slashed(path))
    out = low.endswith("_test.go") | low.contains("/vendor/") | low.startswith("vendor/")
    for marker in EXCLUDED_MARKERS:
        out = out | low.contains(marker)
    return out


def is_exported(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def in_folder(path: Column, folder: str) -> Column:
    """The folder itself or what lies below it."""
    folder = folder.strip("/")
    return (path == folder) | path.startswith(f"{folder}/")


def in_file(path: Column, file: str) -> Column:
    """The file by its whole path, or by a suffix that begins at a segment."""
    return (path == file) | path.endswith(f"/{file}")


def has_folder(path: Column, words: list[str]) -> Column:
    """Whether one of the words is a folder below another one on the path."""
    out = F.lit(False)
    for w in words:
        out = out | path.contains(f"/{w}/")
    return out
