"""Operator parameters: literals arrive as strings or Python values and are checked before a plan is built."""

from __future__ import annotations

import re


class OperatorError(ValueError):
    """Base of all errors an operator raises while its plan is built."""


class InputCount(OperatorError):
    def __init__(self, name: str, want: str, got: int):
        super().__init__(f"{name} takes {want} input(s), got {got}")


class InvalidParam(OperatorError):
    pass


class Unsupported(OperatorError):
    """The operator is registered, but always fails (formats without a decoder)."""


class Params(dict):
    """Typed access to an operator's parameters."""

    def text(self, key: str, default: str | None = None) -> str:
        value = self.get(key, default)
        if value is None:
            raise InvalidParam(f"parameter '{key}' is missing")
        return value.decode() if isinstance(value, bytes) else str(value)

    def int(self, key: str, default: int | None = None, low: int | None = None, high: int | None = None) -> int:
        value = self.get(key, default)
        if value is None:
            raise InvalidParam(f"parameter '{key}' is missing")
        try:
            number = int(value)
        except (TypeError, ValueError):
            raise InvalidParam(f"parameter '{key}' is no integer: {value!r}") from None
        if low is not None and number < low or high is not None and number > high:
            raise InvalidParam(f"parameter '{key}' is out of range: {number}")
        return number

    def float(self, key: str, default: float | None = None, low: float | None = None, high: float | None = None) -> float:
        value = self.get(key, default)
        try:
            number = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            raise InvalidParam(f"parameter '{key}' is no number: {value!r}") from None
        if low is not None and number < low or high is not None and number > high:
            raise InvalidParam(f"parameter '{key}' is out of range: {number}")
        return number

    def bool(self, key: str, default: bool = False) -> bool:
        return str(self.get(key, default)).lower() in ("true", "1", "yes")

    def hex(self, key: str, sizes: tuple[int, ...] | None = None) -> bytes:
        value = self.text(key)
        if len(value) % 2 or not re.fullmatch(r"[0-9a-fA-F]*", value):
            raise InvalidParam(f"parameter '{key}' is no hex string")
        raw = bytes.fromhex(value)
        if sizes is not None and len(raw) not in sizes:
            raise InvalidParam(f"parameter '{key}' must have {' or '.join(map(str, sizes))} bytes, has {len(raw)}")
        return raw

    def list(self, key: str, default: str | list | None = None) -> list[str]:
        value = self.get(key, default)
        if value is None:
            raise InvalidParam(f"parameter '{key}' is missing")
        return [str(v) for v in value] if isinstance(value, (list, tuple)) else [v.strip() for v in str(value).split(",") if v.strip()]

    def choice(self, key: str, allowed: tuple[str, ...], default: str | None = None) -> str:
        value = self.text(key, default)
        if value not in allowed:
            raise InvalidParam(f"parameter '{key}' must be one of {', '.join(allowed)}, is {value!r}")
        return value
