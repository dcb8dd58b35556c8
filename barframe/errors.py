"""One exception with a stable code."""

from __future__ import annotations

CODES = ("IO", "SQLITE", "JSON", "INVALID_INPUT", "INVALID_DATA", "NOT_FOUND")


class BarframeError(Exception):
    def __init__(self, code: str, message: str, **details):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(message)
        self.code, self.message, self.details = code, message, details

    def __str__(self) -> str:
        return f"{self.code}: {self.message}"


def invalid_input(message: str) -> BarframeError:
    return BarframeError("INVALID_INPUT", message)


def invalid_data(message: str) -> BarframeError:
    return BarframeError("INVALID_DATA", message)


def not_found(message: str) -> BarframeError:
    return BarframeError("NOT_FOUND", message)
