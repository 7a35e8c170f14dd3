"""Extraction errors, and a decorator that logs what it lets through."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("varak")


@dataclass(frozen=True)
class ExtractionError:
    """What went wrong with one file."""

    message: str
    file_path: str
    error_type: str
    details: dict[str, str] | None = None


class ExtractionFailed(Exception):
    def __init__(self, error: ExtractionError):
        super().__init__(f"{error.error_type} in {error.file_path}: {error.message}")
        self.error = error


def logged(function: Callable) -> Callable:
    """Log any exception of the function with its name, then raise it again."""

    @functools.wraps(function)
    def call(*args, **kwargs):
        try:
            return function(*args, **kwargs)
        except Exception:
            log.exception("%s failed", function.__name__)
            raise

    return call


def errors_of(extracted: DataFrame) -> DataFrame:
    """The side table of failures: message, file_path, error_type, details."""
    return extracted.where(F.col("error").isNotNull()).select("error.*")


def raise_first(extracted: DataFrame) -> None:
    """Raise the first failure, if there is any."""
    for row in errors_of(extracted).limit(1).collect():
        raise ExtractionFailed(ExtractionError(**row.asDict()))
