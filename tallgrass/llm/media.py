"""Media columns: payloads stored as progressive JPEG files, read back, and turned into full-resolution RGB tensors.

The files are written and read by `jpeg` in numpy, a batch of rows at a time; a payload's bytes are the quantised
coefficients, so that storing them is lossless. Both steps are narrow: no shuffle, and memory bounded by a batch of
about BATCH payload bytes (a longer payload is a batch of its own, and costs memory in proportion).

Defined cases: a null text counts as empty and an empty payload is one unit of 192 spaces; equal texts give equal files
and features; a null media value decodes to nulls; an empty table gives an empty result; extra columns pass through,
output names that clash get a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import jpeg
from .common import fresh, sliced

UNIT, BATCH = 192, 2 << 20


def batched(values: list[bytes | None], most: int = BATCH) -> Iterator[tuple[list[int], list[bytes]]]:
    """Places and values of those that are not null, in runs of about `most` bytes."""
    at, out, size = [], [], 0
    for i, v in enumerate(values):
        if v is None:
            continue
        if out and size + len(v) > most:
            yield at, out
            at, out, size = [], [], 0
        at.append(i)
        out.append(v)
        size += len(v)
    if out:
        yield at, out


def store(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds the JPEG file of every whole text (UTF-8, filled up with spaces) and the text's length in bytes."""
    names, at = fresh(docs, media, n_bytes), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(at).to_pylist()]
            filled = [v + b" " * (-len(v) % UNIT if v else UNIT) for v in raw]
            files: list[bytes] = [b""] * len(raw)
            for places, values in batched(filled):
                for i, f in zip(places, jpeg.encode(values), strict=True):
                    files[i] = f
            added = [pa.array(files, pa.binary()), pa.array([len(v) for v in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    fields = [T.StructField(names[0], T.BinaryType()), T.StructField(names[1], T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def load(stored: DataFrame, media: str = "media", tensor: bool = True) -> DataFrame:
    """Adds payload (read back from the coefficients), feature, and with `tensor` height, width and rgb (row-major bytes)."""
    names, at = fresh(stored, "payload", "feature", "height", "width", "rgb"), stored.columns.index(media)
    kinds = [pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    if not tensor:
        names, kinds = names[:2], kinds[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows: list[tuple] = [(None,) * len(kinds)] * b.num_rows
            for places, files in batched(b.column(at).to_pylist(), 2 * BATCH):
                coefs, parsed = jpeg.coefficients(files)
                same = all((x.steps == parsed[0].steps).all() for x in parsed)
                blocks = jpeg.pixels(coefs, parsed[0].steps) if same else np.concatenate([jpeg.pixels(coefs[x.layout.base : x.layout.base + 6 * x.layout.units], x.steps) for x in parsed])
                for i, x in zip(places, parsed, strict=True):
                    rgb = jpeg.rgb_of(blocks, x.layout)
                    row = (jpeg.payload_of(coefs, x), jpeg.feature_of(rgb), rgb.shape[0], rgb.shape[1])
                    rows[i] = (*row, rgb.tobytes()) if tensor else row[:2]
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    types = [T.BinaryType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.BinaryType()]
    fields = [T.StructField(n, t) for n, t in zip(names, types, strict=False)]
    return stored.mapInArrow(run, T.StructType([*stored.schema.fields, *fields]))
