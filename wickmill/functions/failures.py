"""Failure categories and the outcome of a retry, over a log of failed jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure type names per category, and the words that mark a refused request.
RATE_LIMITED_TYPES = ("RateLimitError", "TemporaryBanError")
NETWORK_TYPES = (
    "NetworkError", "RequestError", "TransportError", "TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout",
    "PoolTimeout", "ConnectError", "ReadError", "WriteError", "CloseError", "ProtocolError", "ProxyError", "TimeoutError",
    "ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "ConnectionAbortedError", "BrokenPipeError",
)
VALIDATION_TYPES = (
    "PayloadCorruptionError", "MalformedMessageError", "ValueError", "JSONDecodeError", "UnicodeDecodeError", "UnicodeEncodeError",
    "UnicodeError",
)
API_TYPES = ("APIError",)
DATABASE_TYPES_PATTERN = "OperationalError|DBAPIError|InterfaceError"
AUTHENTICATION_PATTERN = "401|403|auth|api key"
PERMANENT_PATTERN = "400|invalid symbol|illegal"
RETRYABLE_CATEGORIES = ("RATE_LIMITED", "NETWORK", "DATABASE", "TRANSIENT")
DEFAULT_MAX_RETRIES = 5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def error_category(error_type: Column | str, message: Column | str) -> Column:
    """Category of a failure from its type name (with or without its module) and message text."""
    kind, text = F.substring_index(_col(error_type), ".", -1), F.lower(F.coalesce(_col(message), F.lit("")))
    api = (
        F.when(text.rlike(AUTHENTICATION_PATTERN), "AUTHENTICATION")
        .when(text.rlike(PERMANENT_PATTERN), "PERMANENT")
        .otherwise("TRANSIENT")
    )
    return (
        F.when(kind.isin(*RATE_LIMITED_TYPES), "RATE_LIMITED")
        .when(kind.isin(*NETWORK_TYPES), "NETWORK")
        .when(kind.isin(*VALIDATION_TYPES), "VALIDATION")
        .when(kind.isin(*API_TYPES), api)
        .when(kind.rlike(DATABASE_TYPES_PATTERN), "DATABASE")
        .otherwise("TRANSIENT")
    )


def is_retryable(category: Column | str) -> Column:
    return _col(category).isin(*RETRYABLE_CATEGORIES)


def status_after_failure(category: Column | str, retry_count: Column | str, max_retries: Column | str) -> Column:
    """``pending`` while one more try is allowed (the raised count may equal the maximum), else ``failed``."""
    again = is_retryable(category) & (_col(retry_count) + 1 <= _col(max_retries))
    return F.when(again, "pending").otherwise("failed")
