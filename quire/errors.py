"""Errors with stable codes, on the driver and as row values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stable codes of errors and of extraction warnings.
ERROR_CODES = ("document-not-found", "encrypted-source", "malformed-source", "markdown-parse-error", "missing-text", "name-collision", "unit-not-found", "unresolved-resource", "unsupported-structure", "validation-error")
WARNING_CODES = ("encrypted-source", "malformed-source", "missing-text", "unsupported-structure", "unresolved-resource", "low-confidence", "dropped-content", "decorative-image", "ambiguous-structure", "name-collision", "write-failed")


class EngineError(Exception):
    """An error that callers tell apart by ``code``."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


class ValidationError(EngineError):
    def __init__(self, message: str) -> None:
        super().__init__("validation-error", message)


def row_error(code: str, message: Column | str) -> Column:
    """An ``error`` struct for a row that failed while others go on."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), message.alias("message"))
