"""Media columns: images of lossless WebP to pixel arrays and back.

decode_column reads a column of files; store_texts is the text payload's round trip: a text's bytes,
filled up with blanks to whole rows of 64 RGB pixels, are stored as one or more WebP files end to end
(MOST_ROWS rows each, so memory is bounded), read back and described.

Defined results: null files give null pixels; files that can't be decoded, or have too many pixels, give
null pixels and the reason, other rows go on; a null or empty text is one row of blanks; repeated rows give equal values;
an empty table gives an empty result; other columns stay (decode_column) or are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import each_text

ROW, MOST_ROWS, MOST_PIXELS = 192, 2048, 1 << 24


def store(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(webp.encode_samples(rows[i : i + MOST_ROWS]) for i in range(0, len(rows), MOST_ROWS))


def files(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at : at + size]
        at += size


def load(media: bytes) -> np.ndarray:
    """The pixels of all files, (rows, 64, 3): R, G, B."""
    return np.concatenate([webp.decode(f)[..., 1:] for f in files(media)])


def feature(px: np.ndarray) -> str:
    """Rows, mean and deviation of each channel, and 64 bits: which of 64 runs of pixels are brighter than all."""
    flat = px.reshape(-1, 3).astype(np.int64)
    n = len(flat)
    mean = flat.sum(0) / n
    spread = np.sqrt(np.maximum(0, (flat * flat).sum(0) / n - mean * mean))
    light = flat @ np.array([299, 587, 114])
    cuts = np.arange(64) * n // 64
    runs = np.add.reduceat(light, cuts) / np.diff(np.append(cuts, n))
    bits = np.packbits(runs > light.mean()).tobytes().hex()
    return f"{px.shape[0]};" + ",".join(f"{x:.3f}" for x in (*mean, *spread)) + f";{bits}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(text: bytes) -> tuple:
        media = store(text + b" " * ((-len(text)) % ROW or (0 if text else ROW)))
        px = load(media)
        back = px.tobytes()
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(px)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            made = [one(t) for t in each_text(batch.column("text"))]
            columns = zip(*made, strict=True) if made else ((),) * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def decode_column(df: DataFrame, column: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """df with column_height, column_width, column_pixels (bytes: R, G, B, A) and column_error. A file of a few bytes
    can stand for an image of 2^28 pixels, so images of more than most_pixels are errors. Columns of df must not have
    these names (ValueError)."""
    new = [f"{column}_{x}" for x in ("height", "width", "pixels", "error")]
    if set(new) & set(df.columns):
        raise ValueError(f"columns of these names are added: {new}")
    own = df.columns

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None
        try:
            px = webp.decode(data, most_pixels)
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, str(e)[:200] or "corrupt"
        return px.shape[0], px.shape[1], px[..., [1, 2, 3, 0]].tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # pixels of a few images at a time
                part = batch.slice(i, 64)
                a, b, c, d = zip(*map(one, part.column(column).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(d, pa.string())], [*own, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {t}" for n, t in zip(new, ("int", "int", "binary", "string"), strict=True))])
    return df.mapInArrow(run, schema)
