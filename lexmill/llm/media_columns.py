"""Media columns: texts as baseline JPEG images and back, with dimensions and thumbnail hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import jpeg
from lexmill.llm.common import batch, columns, pieces, utf8

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())])
KINDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def thumbnail_hash(grid: np.ndarray) -> str:
    """16 hex digits: which of 8 x 8 fields of a thumbnail are brighter than their mean."""
    edges = [np.arange(8) * n // 8 for n in grid.shape]
    if min(grid.shape) < 8:
        fields = grid[np.ix_(*edges)].astype(float)
    else:
        sums = np.add.reduceat(np.add.reduceat(grid.astype(np.int64), edges[0], 0), edges[1], 1)
        fields = sums / np.outer(*(np.diff(np.r_[e, n]) for e, n in zip(edges, grid.shape, strict=True)))
    return np.packbits(fields.ravel() > fields.mean()).tobytes().hex()


def feature(thumbnails: list[np.ndarray], images: list[jpeg.Image]) -> str:
    return ";".join(f"{im.width}x{im.height}:{thumbnail_hash(t)}" for t, im in zip(thumbnails, images, strict=True))


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts filled with spaces to a positive multiple of a row of samples, and their sizes then."""
    n = np.diff(off)
    size = np.maximum(1, -(-n // jpeg.ROW)) * jpeg.ROW
    out = np.full(int(size.sum()), 32, np.uint8)
    shift = np.repeat(np.cumsum(size) - size - off[:-1], n)
    out[np.arange(off[0], off[-1]) + shift] = data[off[0] : off[-1]]
    return out, size


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores each text as a greyscale baseline JPEG and reads its columns from the stored bytes.

    The payload is the UTF-8 text and spaces up to a positive multiple of 192 bytes. A byte is the 8-bit sample of one
    flat 8 x 8 block, so the DC-only thumbnail that the reader rebuilds is the payload, without loss; long texts take
    several images. The feature has each image's dimensions and the hash of its thumbnail. Returns a row for each row of
    docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (the payload's last 16 bytes), media_bytes,
    media_sha256, feature and media (the file).

    Defined cases: a null text is empty, and an empty one is 192 spaces; equal texts give equal values; rows with a null
    doc_id and repeated rows are stored like others; an empty table gives an empty table; other columns are ignored.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, off = utf8(rows.column("text"))
            for i, j in pieces(off, 1 << 20):
                files = jpeg.written(*padded(data, off[i : j + 1]))
                out = []
                for f, thumbnails in zip(files, jpeg.luminance(files), strict=True):
                    payload = b"".join(t.tobytes() for t in thumbnails)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature(thumbnails, jpeg.parsed(f))))
                yield batch(OUT, rows.column("doc_id").slice(i, j - i), np.diff(off[i : j + 1]), *zip(*out, strict=True), files)

    return columns(docs, doc_id="long", text="string").mapInArrow(stored, KINDS)


def thumbnails(media: DataFrame) -> DataFrame:
    """For a table of JPEG files (id, media): id, width and height of the first image, its DC-only luminance thumbnail, its hash, and what is wrong with files that are no baseline JPEG."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for f in rows.column("media").to_pylist():
                try:
                    im, t = jpeg.parsed(f or b"")[0], jpeg.luminance([f])[0][0]
                    out.append((im.width, im.height, t.tobytes(), thumbnail_hash(t), None))
                except (ValueError, IndexError, KeyError, StopIteration) as e:
                    out.append((None, None, None, None, str(e) or type(e).__name__))
            kinds = pa.schema([("id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail", pa.binary()), ("hash", pa.string()), ("error", pa.string())])
            yield batch(kinds, rows.column("id"), *(zip(*out, strict=True) if out else [[]] * 5))

    return media.select(F.col("id").cast("long"), F.col("media").cast("binary")).mapInArrow(read, "id long, width int, height int, thumbnail binary, hash string, error string")
