"""Members of archives as rows (path, member, size, content), one archive per input row."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.archives import tar_members, zip_members


def members(df: DataFrame, fmt: str = "zip", path: str = "path", content: str = "content") -> DataFrame:
    """The files of tar, tar_gz or zip archives; a row for each, emitted archive by archive."""
    def run(batches):
        for pdf in batches:
            for p, body in zip(pdf[path], pdf[content], strict=True):
                data = bytes(body)
                found = zip_members(data) if fmt == "zip" else ((n, d) for n, _, d in tar_members(gzip.decompress(data) if fmt == "tar_gz" else data))
                for name, d in found:
                    yield pd.DataFrame({"path": [p], "member": [name], "size": [len(d)], "content": [d]})

    return df.select(path, content).mapInPandas(run, "path string, member string, size long, content binary")
