"""What the operators of this subpackage share: tables in the shared folder, and the packing of numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

from quern.storage import drop_table, new_dir, settle, shared_dir

__all__ = ["drop_table", "narrowed", "new_dir", "pack", "pack_counts", "pack_sorted", "partitions", "settle", "shared_dir", "trim", "unpack", "unpack_counts", "unpack_sorted"]


def trim() -> None:
    """Give memory that this worker has freed back to the system; idle workers stay beside an executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array; the reader knows the dtype."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """For ascending uint64: differences, byte planes apart so that their zero bytes compress."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return pack(np.ascontiguousarray(d.view(np.uint8).reshape(-1, a.dtype.itemsize).T))


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def narrowed(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest unsigned type that holds them."""
    top = int(a.max()) if a.size else 0
    return a.astype(next(f"u{w}" for w in (1, 2, 4, 8) if top < 1 << 8 * w))


def pack_counts(a: np.ndarray) -> bytes:
    """For small non-negative integers: the narrowest unsigned type that holds them, named by the first byte, in planes."""
    a = narrowed(a)
    return bytes([a.dtype.itemsize]) + pack(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def unpack_counts(b: bytes, narrow: bool = False) -> np.ndarray:
    """As int64, or in the type that they were packed in."""
    planes = unpack(b[1:], np.uint8).reshape(b[0], -1)
    found = np.ascontiguousarray(planes.T).reshape(-1).view(f"u{b[0]}")
    return found if narrow else found.astype(np.int64)
