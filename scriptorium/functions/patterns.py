"""Search patterns as the engine reads them."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def valid_pattern(pattern: str) -> bool:
    """Whether the engine accepts the pattern; its dialect differs from Python's."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True
