"""The function registry: (name, version) to a function from Columns to a Column.

Two kinds of functions share it.  *Native* functions build Spark expressions, which Catalyst optimises and codegen runs.
*Python* functions work on bytes and run row by row in Python workers; they exist where Spark has no expression for a format.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .params import InputCount, Params, Unsupported

VERSION = "1.0.0"


@dataclass(frozen=True)
class FunctionId:
    name: str
    version: str = VERSION

    def __str__(self) -> str:
        return f"{self.name}/{self.version}"


@dataclass(frozen=True)
class Function:
    id: FunctionId
    kind: str  # native, python or unsupported
    low: int
    high: int | None
    build: Callable[..., Column]
    plain: Callable | None = None  # the bytes function of a Python function
    doc: str = ""

    def __call__(self, *inputs: Column | str, **params) -> Column:
        if len(inputs) < self.low or self.high is not None and len(inputs) > self.high:
            raise InputCount(self.id.name, f"{self.low}" if self.high == self.low else f"{self.low} or more" if self.high is None else f"{self.low} to {self.high}", len(inputs))
        return self.build([F.col(c) if isinstance(c, str) else c for c in inputs], Params(params))


_functions: dict[FunctionId, Function] = {}


def _add(f: Function) -> None:
    _functions[f.id] = f


def native(*names: str, inputs: int | tuple[int, int | None] = 1):
    """Register ``f(columns, params) -> Column`` under one or more names."""
    low, high = inputs if isinstance(inputs, tuple) else (inputs, inputs)

    def wrap(f):
        for name in names:
            _add(Function(FunctionId(name), "native", low, high, f, doc=f.__doc__ or ""))
        return f

    return wrap


def plain_value(v, returns: str):
    """``v`` as the type that rows of ``returns`` take: bytes and texts stand for each other as UTF-8, NumPy's numbers for Python's."""
    if v is None:
        return None
    if returns in ("binary", "string"):
        raw = v.encode() if isinstance(v, str) else bytes(memoryview(v))
        return raw if returns == "binary" else raw.decode()
    return v.item() if hasattr(v, "item") else v


def python(*names: str, inputs: int | tuple[int, int | None] = 1, returns: str = "binary"):
    """Register ``f(inputs: list[bytes], params) -> bytes`` (or str, bool, int by ``returns``) as a function of rows.

    A null input gives null; an exception fails the task with the function's name.
    """
    low, high = inputs if isinstance(inputs, tuple) else (inputs, inputs)

    def wrap(f):
        def build(columns: list[Column], params: Params) -> Column:
            check = getattr(f, "check", None)
            if check is not None:
                check(params)
            given = dict(params)
            name = names[0]

            @wraps(f)
            def run(*row):
                if any(x is None for x in row):
                    return None
                try:
                    return plain_value(f([bytes(x) for x in row], Params(given)), returns)
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e

            # Blobs may be long: an Arrow batch would hold 10,000 of them, and once more for each function of a chain.
            # Pickled rows go to the workers by the hundred.
            udf = F.udf(run, returns, useArrow=False)
            return udf(*(c.cast("binary") for c in columns))

        for name in names:
            _add(Function(FunctionId(name), "python", low, high, build, f, f.__doc__ or ""))
        return f

    return wrap


def unsupported(*names: str, why: str) -> None:
    """Register ids that always raise: nothing here reads or writes their format."""
    for name in names:
        def build(columns, params, name=name):
            raise Unsupported(f"{name}: {why}")

        _add(Function(FunctionId(name), "unsupported", 0, None, build, doc=why))


def get(name: str, version: str = VERSION) -> Function:
    load()
    try:
        return _functions[FunctionId(name, version)]
    except KeyError:
        raise KeyError(f"no function {name}/{version}") from None


def call(name: str, *inputs: Column | str, **params) -> Column:
    """The Column that function ``name`` makes of ``inputs``."""
    return get(name)(*inputs, **params)


def contains(name: str, version: str = VERSION) -> bool:
    load()
    return FunctionId(name, version) in _functions


def names(kind: str | None = None) -> list[str]:
    load()
    return sorted(f.id.name for f in _functions.values() if kind is None or f.kind == kind)


def load() -> None:
    """Import every module that registers functions."""
    from . import functions

    functions.load()


def register_sql(spark: SparkSession, *which: str) -> None:
    """Make Python functions of one argument and without parameters callable from SQL."""
    for name in which:
        f = get(name)

        def run(s: pd.Series, plain=f.plain) -> pd.Series:
            return s.map(lambda x: None if x is None else plain([bytes(x)], Params()))

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR))
