"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.runtime import durable  # noqa: F401

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

_names = itertools.count()


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Catalyst re-evaluates an outer expression for every element when a lambda refers to it; a
    one-element ``transform`` turns it into a lambda variable, which is computed only once.
    """
    return F.transform(F.array(value), body).getItem(0)


def fresh(stem: str) -> str:
    """A column name that no input column has."""
    return f"__fl_{stem}_{next(_names)}"


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def give_back() -> None:
    """Return to the system what earlier tasks of this Python worker have freed; workers outlive their stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
