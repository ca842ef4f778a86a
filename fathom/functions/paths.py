"""Path expressions: normal form, test files, suffixes, folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.vocabulary import EXCLUDED_DIRECTORIES


def display_path(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(path, "\\", "/")


def normalize_path(path: Column) -> Column:
    """Lower case, slashes only, without blanks around it, leading ./ and slashes at either end."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(display_path(path)), r"^(\./)+", ""), r"^/+|/+$", ""))


def is_test_path(path: Column) -> Column:
    """Below a tests folder, or named like a test module or conftest.py."""
    n = normalize_path(path)
    name = F.regexp_extract(n, r"([^/]*)$", 1)
    return F.contains(F.concat(F.lit("/"), n, F.lit("/")), F.lit("/tests/")) | (name == "conftest.py") | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py"))


def folder(path: Column) -> Column:
    """The parent folder; '.' for a path without one."""
    return F.when(F.contains(display_path(path), F.lit("/")), F.regexp_extract(display_path(path), r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(display_path(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def is_suffix_match(a: Column, b: Column) -> Column:
    """Equal, or one is the other's end from a slash on; empty paths match nothing."""
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a)))


def module_parts(path: Column) -> Column:
    """A file's dotted path as an array, without extension and trailing __init__."""
    parts = F.filter(F.split(F.regexp_replace(F.translate(display_path(path), ":", ""), r"\.[^./]*$", ""), "/"), lambda p: F.trim(p).isin("", ".") == F.lit(False))
    return F.when(F.try_element_at(parts, F.lit(-1)) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def module_suffixes(path: Column) -> Column:
    """Every dotted name under which a file may be imported: all suffixes of its path, longest first."""
    parts = module_parts(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def is_excluded(relative_path: Column) -> Column:
    """Below a folder that scans leave out."""
    names = "|".join(n.replace(".", r"\.") for n in EXCLUDED_DIRECTORIES)
    return F.concat(F.lit("/"), display_path(relative_path)).rlike(rf"/(?:{names}|\.pytest_tmp[^/]*)/")
