"""Cutting contents into chunks: by line, or by content.

Content-defined cuts follow FastCDC as published (2020): a rolling gear hash, a hard mask before the target size
and an easy one after it, minimum and maximum sizes. The gear table is derived by rule from SHA-256, so
cuts are stable here, but not those of other tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.cbor import object_id

MINIMUM, TARGET, MAXIMUM = 512 << 10, 1 << 20, 8 << 20


def line_chunks(files: DataFrame, key: str, content: str, bits: int = 224) -> DataFrame:
    """One chunk per line: key, seq, length (bytes), blob_id (hex digest)."""
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("seq", "chunk"))
    return lines.select(key, "seq", F.octet_length("chunk").cast("long").alias("length"), ids.digest(F.col("chunk"), bits).alias("blob_id"))


def whole_file_chunks(files: DataFrame, key: str, content: str, bits: int = 224) -> DataFrame:
    """One chunk per file, as for files under the minimum size; empty files have none."""
    size = F.octet_length(content).cast("long")
    return files.where(size > 0).select(
        key, F.lit(0).alias("seq"), F.lit(0).cast("long").alias("offset"), size.alias("length"), ids.digest(F.col(content), bits).alias("blob_id"),
    )


def gear() -> np.ndarray:
    """256 64-bit values: the first 8 bytes of SHA-256 of "gear" and the byte's number."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:8], "big") for i in range(256)], np.uint64)


def _mask(bits: int) -> int:
    """``bits`` ones spread over the upper 48 bits."""
    return sum(1 << (63 - i * 48 // bits) for i in range(bits))


def cuts(data: bytes, minimum: int = MINIMUM, target: int = TARGET, maximum: int = MAXIMUM) -> list[int]:
    """Ends of the chunks of a content; none for an empty one.

    The gear hash over the last 64 bytes is computed for whole stretches at once, by doubling.
    """
    n, bits = len(data), max(1, target.bit_length() - 1)
    hard, easy = np.uint64(_mask(bits + 1)), np.uint64(_mask(max(1, bits - 1)))
    table, out, start = gear(), [], 0
    while start < n:
        stop = min(n, start + maximum)
        if stop - start <= minimum:
            out.append(stop)
            start = stop
            continue
        middle = min(stop, start + max(target, minimum))
        end = None
        for a, b, mask in ((start + minimum, middle, hard), (middle, stop, easy)):
            while a < b and end is None:
                part = min(b, a + (1 << 18))
                first = max(start, a - 63)
                h = table[np.frombuffer(data, np.uint8, part - first, first)]
                for k in range(6):  # after step k a hash covers 2 ** (k + 1) bytes
                    wide = 1 << k
                    shifted = np.zeros_like(h)
                    shifted[wide:] = h[:-wide] << np.uint64(wide) if len(h) > wide else h[:0]
                    h = h + shifted
                hit = np.flatnonzero((h[a - first :] & mask) == 0)
                if len(hit):
                    end = a + int(hit[0]) + 1
                a = part
            if end is not None:
                break
        out.append(end or stop)
        start = out[-1]
    return out


CHUNKS = "seq int, offset long, length long, blob_id string, bytes binary"


def content_chunks(files: DataFrame, key: str, content: str, minimum: int = MINIMUM, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """Content-defined chunks: key, seq, offset, length, blob_id (base32), bytes. Null contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                ends = cuts(data, minimum, target, maximum) if data else []
                begins = [0, *ends][:-1]
                parts = [data[a:b] for a, b in zip(begins, ends, strict=True)]
                name = batch.column(0).take(pa.array([i] * len(ends), pa.int64()))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = (list(range(len(ends))), begins, [len(p) for p in parts], [object_id(p) for p in parts], parts)
                yield pa.RecordBatch.from_arrays(
                    [name, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=[batch.schema.names[0], "seq", "offset", "length", "blob_id", "bytes"],
                )

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col(content).cast("binary").alias("__content")).mapInArrow(run, f"`{key}` {kind}, {CHUNKS}")
