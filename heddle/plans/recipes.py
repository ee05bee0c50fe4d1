"""Recipes: datasets named by the computation that makes them.

A leaf is a DataFrame named by its content: SHA-256 over its schema, its number of rows and two sums of row hashes, which do not depend
on the order of rows.  A recipe is (function, version, ordered inputs, parameters); its address is the SHA-256 of a canonical JSON
form in which parameters are sorted and inputs are not.  ``materialise`` builds one lazy plan for an address; equal
sub-recipes have one address and so one plan, which Spark's exchange reuse can share.

Recipes name table functions, every registered function of blobs (over tables (key, content), several inputs joined on key) and
every stream function (over chunk tables).  With a ``root`` folder leaves, recipes and pins are tables there, and a new
``Store`` on the same folder has them all; what is cached lies beside them as Parquet.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..operators import relational as R
from ..params import OperatorError
from ..staging import stage, unstage
from ..streaming import chunks
from . import lineage

RECIPES = "addr string, function string, version string, inputs array<string>, params array<struct<k:string,v:string>>"
PINS = "addr string, pinned boolean, at long"


class CycleDetected(OperatorError):
    pass


class NotFound(OperatorError):
    pass


class NotDeterministic(OperatorError):
    pass


def address_of(value: bytes | str) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


@dataclass(frozen=True)
class Recipe:
    function: str
    inputs: tuple[str, ...]
    params: tuple[tuple[str, str], ...] = ()
    version: str = "1.0.0"

    @classmethod
    def of(cls, function: str, inputs, params: dict | None = None, version: str = "1.0.0") -> Recipe:
        form = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True)
        return cls(function, tuple(inputs), tuple(sorted((k, form(v)) for k, v in (params or {}).items())), version)

    @property
    def canonical(self) -> str:
        return json.dumps([self.function, self.version, list(self.inputs), [list(p) for p in self.params]], separators=(",", ":"))

    @property
    def address(self) -> str:
        return address_of(self.canonical)

    def arguments(self) -> dict:
        def back(v):
            try:
                return json.loads(v) if v[:1] in "[{" else v
            except ValueError:
                return v

        return {k: back(v) for k, v in self.params}


#: Table functions that recipes name: (inputs, params) to a DataFrame.
TABLE_FUNCTIONS: dict[str, Callable[[list[DataFrame], dict], DataFrame]] = {
    "filter": lambda x, p: R.filter_rows(x[0], p["column"], p["op"], p.get("value")),
    "select": lambda x, p: R.select_columns(x[0], p["columns"]),
    "rename": lambda x, p: R.rename_columns(x[0], p["mapping"]),
    "join": lambda x, p: R.join_tables(x[0], x[1], p["on"], p.get("how", "inner")),
    "aggregate": lambda x, p: R.aggregate(x[0], p["column"], p["function"], p.get("by")),
    "deduplicate": lambda x, p: R.deduplicate(x[0], p.get("columns"), p.get("order")),
    "union": lambda x, p: R.union(*x),
    "frequency": lambda x, p: x[0].groupBy(F.col(p["column"]).alias("value")).agg(F.count("*").alias("n")),
    "sort": lambda x, p: R.sort_rows(x[0], p["column"], p.get("order", "asc")),
}


def _blobs(name: str, version: str, inputs: list[DataFrame], params: dict) -> DataFrame:
    """A registered function over blob tables (key, content)."""
    both = inputs[0].select("key", F.col("content").alias("c0"))
    for i, other in enumerate(inputs[1:], 1):
        both = both.join(other.select("key", F.col("content").alias(f"c{i}")), "key")
    columns = [F.col(f"c{i}") for i in range(len(inputs))]
    return both.select("key", registry.get(name, version)(*columns, **params).alias("content"))


def apply_function(name: str, version: str, inputs: list[DataFrame], params: dict) -> DataFrame:
    """What a recipe's function makes of its inputs."""
    if name in TABLE_FUNCTIONS and version == registry.VERSION:
        return TABLE_FUNCTIONS[name](inputs, params)
    if name in chunks.names() and version == registry.VERSION:
        return chunks.apply(name, *inputs, **params)
    if registry.contains(name, version):
        return _blobs(name, version, inputs, params)
    raise NotFound(f"unknown function {name}/{version}")


def content_address(df: DataFrame) -> str:
    """One pass over the rows; equal rows in any order have one address."""
    row = F.struct(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns))
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{seed}") for seed in (1, 2)]
    one = df.agg(F.count("*").alias("n"), *sums).first()
    return address_of(json.dumps(["leaf", json.loads(df.schema.json()), one["n"], one["s1"], one["s2"]]))


class Policy(Enum):
    """What invalidating an address does to what depends on it."""

    NONE = "none"
    IMMEDIATE = "immediate"
    DRY_RUN = "dry_run"


class Verification(Enum):
    OFF = "off"
    DUAL = "dual"
    SAMPLED = "sampled"


@dataclass
class Cached:
    """A kept result: its table, bytes, the time it took and how often it was asked for."""

    df: DataFrame
    size: int
    cpu_ms: float
    hits: int = 0


@dataclass
class Store:
    """Leaves, recipes, pins and the cache of results."""

    spark: SparkSession
    root: str | None = None
    leaves: dict[str, DataFrame] = field(default_factory=dict)
    recipes: dict[str, Recipe] = field(default_factory=dict)
    cache: dict[str, Cached] = field(default_factory=dict)
    pins: set[str] = field(default_factory=set)
    gets: int = 0
    hits: int = 0

    def __post_init__(self) -> None:
        if self.root and self._there("recipes"):
            rows = self.spark.read.schema(RECIPES).parquet(f"{self.root}/recipes").distinct().collect()
            self.recipes = {r["addr"]: Recipe(r["function"], tuple(r["inputs"]), tuple((p["k"], p["v"]) for p in r["params"]), r["version"]) for r in rows}
        if self.root and self._there("pins"):
            last = self.spark.read.schema(PINS).parquet(f"{self.root}/pins").groupBy("addr").agg(F.max_by("pinned", "at").alias("pinned"))
            self.pins = {r["addr"] for r in last.where("pinned").collect()}

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        if self.root:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def put_leaf(self, df: DataFrame) -> str:
        """Store a leaf under the address of its content (again: the same address, nothing written)."""
        a = content_address(df)
        if self.root:
            if not self._there(f"leaves/{a}/_SUCCESS"):
                df.write.mode("overwrite").parquet(f"{self.root}/leaves/{a}")
            df = self.spark.read.schema(df.schema).parquet(f"{self.root}/leaves/{a}")
        self.leaves[a] = df
        return a

    def leaf(self, address: str) -> DataFrame | None:
        if address not in self.leaves and self.root and self._there(f"leaves/{address}/_SUCCESS"):
            self.leaves[address] = self.spark.read.parquet(f"{self.root}/leaves/{address}")
        return self.leaves.get(address)

    def put_recipe(self, function: str, inputs, params: dict | None = None, version: str = "1.0.0") -> str:
        """Insert a recipe (again: the same address).  All inputs must be known, so no cycle can arise."""
        r = Recipe.of(function, inputs, params, version)
        if r.address in r.inputs:
            raise CycleDetected(f"recipe {r.address} is its own input")
        lost = [i for i in r.inputs if i not in self.recipes and self.leaf(i) is None]
        if lost:
            raise NotFound(f"unknown input {lost[0]}")
        if r.address not in self.recipes:
            self.recipes[r.address] = r
            self._append("recipes", [(r.address, r.function, r.version, list(r.inputs), list(r.params))], RECIPES)
        return r.address

    def resolve(self, address: str) -> Recipe | None:
        return self.recipes.get(address)

    def order(self, address: str) -> list[str]:
        """Inputs before what uses them, each once."""
        done, todo = [], [(address, False)]
        seen: set[str] = set()
        while todo:
            a, ready = todo.pop()
            if ready:
                done.append(a)
            elif a not in seen:
                seen.add(a)
                todo.append((a, True))
                if a in self.recipes:
                    todo += [(i, False) for i in reversed(self.recipes[a].inputs)]
                elif self.leaf(a) is None:
                    raise NotFound(f"unknown address {a}")
        return done

    def materialise(self, address: str, keep: bool = False, verification: Verification = Verification.OFF, rate: float = 1.0) -> DataFrame:
        """One lazy plan for an address.

        ``keep`` writes the result and caches it under the address.  ``verification`` runs a recipe twice first and raises where the runs
        differ: always, or for the share ``rate`` of addresses, chosen by the first byte of the address, so always the same ones.
        """
        if verification is Verification.DUAL or verification is Verification.SAMPLED and self.sampled(address, rate):
            if not self.verify(address):
                raise NotDeterministic(f"two runs of {address} differ")
        self.gets += 1
        if address in self.cache:
            self.hits += 1
            self.cache[address].hits += 1
            return self.cache[address].df
        df = self._plan(address)
        if not keep:
            return df
        begun = time.perf_counter()
        df = stage(df, f"cache-{address}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        size = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        self.cache[address] = Cached(df, size, (time.perf_counter() - begun) * 1000)
        return df

    def _plan(self, address: str, fresh: bool = False) -> DataFrame:
        plans: dict[str, DataFrame] = {}
        for a in self.order(address):
            if a in self.cache and not (fresh and a == address):
                plans[a] = self.cache[a].df
            elif a in self.recipes:
                r = self.recipes[a]
                plans[a] = apply_function(r.function, r.version, [plans[i] for i in r.inputs], r.arguments())
            else:
                plans[a] = self.leaves[a]
        return plans[address]

    def edges(self) -> DataFrame:
        """(addr, input, ordinal) of all recipes."""
        rows = [(a, i, n) for a, r in self.recipes.items() for n, i in enumerate(r.inputs)]
        return self.spark.createDataFrame(rows, "addr string, input string, ordinal int")

    def dependents(self, address: str) -> dict[str, int]:
        """Everything that depends on an address, with its distance."""
        users: dict[str, list[str]] = {}
        for a, r in self.recipes.items():
            for i in set(r.inputs):
                users.setdefault(i, []).append(a)
        found, front, depth = {}, [address], 0
        while front:
            depth += 1
            front = sorted({u for a in front for u in users.get(a, []) if u not in found and u != address})
            found |= dict.fromkeys(front, depth)
        return found

    def cascade(self, address: str, policy: Policy = Policy.IMMEDIATE, include_root: bool = True) -> list[dict]:
        """Drop cached results of what depends on an address; per address its distance and the bytes freed.  A dry run drops nothing."""
        reach = ({address: 0} if include_root else {}) | (self.dependents(address) if policy is not Policy.NONE else {})
        out = [{"addr": a, "depth": d, "size": self.cache[a].size} for a, d in reach.items() if a in self.cache]
        if policy is not Policy.DRY_RUN:
            for row in out:
                unstage(self.cache.pop(row["addr"]).df)
        return out

    def invalidate(self, address: str, cascade: bool = True, dry_run: bool = False) -> list[str]:
        """Drop cached results of an address and, with ``cascade``, of all that depends on it."""
        rows = self.cascade(address, Policy.IMMEDIATE if cascade and not dry_run else Policy.DRY_RUN if dry_run else Policy.NONE)
        return sorted(r["addr"] for r in rows)

    def remove(self, address: str) -> None:
        """Forget a recipe and its result.  What uses it stays and can no longer be planned."""
        self.cascade(address, Policy.NONE)
        self.recipes.pop(address, None)

    def pin(self, address: str) -> None:
        """Neither eviction nor garbage collection touches a pinned address."""
        self.pins.add(address)
        self._append("pins", [(address, True, time.time_ns())], PINS)

    def unpin(self, address: str) -> bool:
        there = address in self.pins
        self.pins.discard(address)
        if there:
            self._append("pins", [(address, False, time.time_ns())], PINS)
        return there

    def list_pins(self) -> list[str]:
        return sorted(self.pins)

    def evict(self, budget: int, pressure: float = 0.8, target: float = 0.6) -> list[str]:
        """Apply ``lineage.eviction`` to the cache."""
        rows = [(a, c.size, float(c.cpu_ms), c.hits, a in self.pins) for a, c in self.cache.items()]
        if not rows:
            return []
        entries = self.spark.createDataFrame(rows, "addr string, size long, cpu_ms double, hits int, pinned boolean")
        lost = sorted(r["addr"] for r in lineage.eviction(entries, budget, pressure, target).collect())
        for a in lost:
            unstage(self.cache.pop(a).df)
        return lost

    def collect_garbage(self, dry_run: bool = False, max_removals: int | None = None) -> list[str]:
        """Drop leaves that no recipe uses and no pin holds."""
        used = {i for r in self.recipes.values() for i in r.inputs} | self.pins
        lost = sorted(a for a in self.leaves if a not in used)[:max_removals]
        for a in [] if dry_run else lost:
            self.cascade(a)
            del self.leaves[a]
            if self.root:
                path, fs = self._path(f"leaves/{a}")
                fs.delete(path, True)
        return lost

    @staticmethod
    def sampled(address: str, rate: float) -> bool:
        """Whether sampled verification takes an address: by its first byte over 255."""
        return int(address[:2], 16) / 255 < rate or rate >= 1

    def verify(self, address: str) -> bool:
        """Whether two runs of a recipe over the same inputs give the same rows."""
        return content_address(self._plan(address, fresh=True)) == content_address(self._plan(address, fresh=True))

    def status(self) -> dict[str, float]:
        return {"leaves": len(self.leaves), "recipes": len(self.recipes), "cached": len(self.cache), "cached_bytes": sum(c.size for c in self.cache.values()), "pinned": len(self.pins), "hit_rate": self.hits / self.gets if self.gets else 0.0}
