"""One error type for every operator: a stable code and details; the message is the code in words."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str | None = None, details: dict | None = None):
        self.code = code
        self.message = message or code.replace("_", " ").capitalize()
        self.details = dict(details or {})
        shown = "".join(f"; {k}={v!r}" for k, v in self.details.items())
        super().__init__(f"{code}: {self.message}{shown}")


def require(condition: bool, code: str, message: str | None = None, **details) -> None:
    if not condition:
        raise EngineError(code, message, details)


def require_columns(df, columns, code: str = "UNKNOWN_COLUMN") -> list[str]:
    """Check names against the schema (no job) and return them without repeats."""
    columns = list(dict.fromkeys(columns or []))
    missing = [c for c in columns if c not in df.columns]
    require(not missing, code, columns=missing)
    return columns
