"""Identifier parsing and result tidying: string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_name(path: Column) -> Column:
    """First token of ``[._]``-separated text."""
    return F.split(path, "[._]").getItem(0)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/?$", 1)


def is_folder(path: Column) -> Column:
    return path.endswith("/")


def as_folder(path: Column) -> Column:
    return F.when(is_folder(path), path).otherwise(F.concat(path, F.lit("/")))


def projection_class(cell_type: Column) -> Column:
    """LHN for NP, MZ or acj6 (any case), mPN where it begins with v, else iPN."""
    return F.when(cell_type.rlike("(?i)np|mz|acj6"), "LHN").when(cell_type.rlike("^v"), "mPN").otherwise("iPN")


def tidy_date(value: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(value, r"\\N", ""), F.lit("yyyy-MM-dd")).cast("date")


def neuron_name(path: Column) -> Column:
    """A file's name up to its first full stop or underscore."""
    return image_name(base_name(path))


def trace_path(folder: str, cell_type: Column, file: Column, suffix: str) -> Column:
    """Where a neuron's trace is expected: folder, cell type, and the file's name with another ending."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), cell_type, F.lit("/"), F.regexp_replace(base_name(file), r"\.[^.]*$", ""), F.lit(suffix))
