"""NumPy, Zarr and Arrow arrays."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pyarrow as pa

from ..registry import python, unsupported
from .json_formats import dumps

DTYPES = ("<f8", "<f4", "<i8", "<i4")


def npy_load(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def npy_dump(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def ipc_dump(t: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue()


def ipc_load(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


@python("numpy_read", "numpy_to_arrow")
def numpy_read(x, p):
    """Arrow stream with one column ``data``, in C order."""
    return ipc_dump(pa.table({"data": npy_load(x[0]).ravel(order="C")}))


@python("numpy_write")
def numpy_write(x, p):
    a = np.frombuffer(x[0], np.dtype(p.choice("dtype", DTYPES, "<f8")))
    return npy_dump(a.reshape([int(n) for n in p.list("shape", [len(a)])]))


@python("arrow_to_numpy")
def arrow_to_numpy(x, p):
    return npy_dump(ipc_load(x[0]).column(0).to_numpy().astype(np.dtype(p.choice("dtype", DTYPES, "<f8"))))


def _zarr(z: zipfile.ZipFile) -> dict[str, dict]:
    return {n[: -len(".zarray")].strip("/"): json.loads(z.read(n)) for n in z.namelist() if n.endswith(".zarray")}


@python("zarr_read")
def zarr_read(x, p):
    """One uncompressed version 2 array of a zipped store, as an Arrow stream with column ``data``."""
    with zipfile.ZipFile(io.BytesIO(x[0])) as z:
        found = _zarr(z)
        name = p.text("array", next(iter(found), "")).strip("/")
        if name not in found:
            raise ValueError(f"no array {name!r}")
        meta = found[name]
        if meta.get("compressor") is not None:
            raise ValueError("compressed chunks are not supported")
        shape, chunks = meta["shape"], meta["chunks"]
        out = np.full(shape, meta.get("fill_value") or 0, np.dtype(meta["dtype"]))
        sep = meta.get("dimension_separator", ".")
        for idx in np.ndindex(*(-(-s // c) for s, c in zip(shape, chunks, strict=True))):
            key = "/".join(filter(None, [name, sep.join(map(str, idx))]))
            if key in z.namelist():
                block = np.frombuffer(z.read(key), out.dtype).reshape(chunks, order=meta.get("order", "C"))
                at = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(idx, chunks, shape, strict=True))
                out[at] = block[tuple(slice(0, s.stop - s.start) for s in at)]
    return ipc_dump(pa.table({"data": out.ravel()}))


@python("zarr_metadata", returns="string")
def zarr_metadata(x, p):
    with zipfile.ZipFile(io.BytesIO(x[0])) as z:
        return dumps([{"path": n, "shape": m["shape"], "chunks": m["chunks"], "dtype": m["dtype"]} for n, m in sorted(_zarr(z).items())])


unsupported("hdf5_metadata", "hdf5_read", "hdf5_write", "netcdf_metadata", "netcdf_read", "fits_metadata", "fits_read", why="there is no codec for this format here")
