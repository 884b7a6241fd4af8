"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
BLANKS = " \t\n\r\x0b\x0c"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def object_key(stream_id: Column, path: Column) -> Column:
    return F.concat(F.lit("streams/"), stream_id, F.lit("/"), file_name(path))


def metadata_key(key: Column) -> Column:
    return F.concat(key, F.lit(".metadata.json"))


def stream_key(path: Column, generation: Column) -> Column:
    """Stream id of one generation of a path; equal on every task retry."""
    return F.md5(F.concat(path, F.lit("#"), generation.cast("string")))


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS))


def number_block(value: Column, width: int, first: int = 0) -> Column:
    """Index of the block of ``width`` numbers that holds ``value``."""
    shifted = value.cast("bigint") - F.lit(first)
    return F.call_function("div", shifted - F.pmod(shifted, F.lit(width)), F.lit(width))


def all_present(*names: str) -> Column:
    """None of the columns is null."""
    test = F.lit(True)
    for name in names:
        test = test & F.col(name).isNotNull()
    return test
