"""Shared pieces of the training-data operators: shared-folder tables, Arrow text blocks, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised kernels; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Tables whose compressed files are larger are not broadcast.
BROADCAST_BYTES = 4 << 20
U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; unset, a temporary one in local mode, an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _fallback.setdefault(spark.sparkContext.applicationId, "")
        if not root:
            root = _fallback[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarrylog-")
    return root.rstrip("/")


_fallback: dict[str, str] = {}


class Workspace:
    """Tables and files of one operator call under the shared folder; removed with drop() or at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._quiet_drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again, so its lineage ends in a table that outlives any executor."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _at(self, name: str | None):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def small(self, df: DataFrame, name: str) -> DataFrame:
        """df, which is read from the table name, marked for broadcast if that table's files are small; Spark chooses otherwise."""
        p, fs = self._at(name)
        return F.broadcast(df) if fs.getContentSummary(p).getLength() <= BROADCAST_BYTES else df

    def drop(self, name: str | None = None) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)

    def _quiet_drop(self) -> None:
        with contextlib.suppress(Exception):
            self.drop()


def give_back() -> None:
    """Return memory that the worker's allocators hold free: reused workers would else keep each step's peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file of the shared folder from a worker; a repeated attempt replaces it as a whole."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(tmp) as f:
            f.write(data)
        store.move(tmp, path)


def map_file(uri: str) -> np.ndarray:
    """A file of the shared folder as read-only mapped bytes (fetched to the worker's own folder first if it isn't a mounted one)."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(uri)
        path = os.path.join(tempfile.gettempdir(), uri.replace("/", "_"))
        if not os.path.exists(path):
            with store.open_input_stream(remote) as src, open(tmp := f"{path}.{os.getpid()}", "wb") as out:
                while part := src.read(1 << 22):
                    out.write(part)
            os.replace(tmp, path)
    if os.path.getsize(path) == 0:
        return np.zeros(0, np.uint8)
    return np.memmap(path, np.uint8, "r")


_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i mod 2^64 for i < n."""
    if len(_pow[0]) < n:
        m = max(n, BLOCK_BYTES + 1024)
        for k, r in ((0, _R), (1, _RINV)):
            a = np.full(m, r, U64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (buf[k] + 1) R^k over i <= k < j."""
    p = np.empty(len(buf) + 1, U64)
    p[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * powers(len(buf))[0], out=p[1:])
    return p


def span_hashes(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], equal for equal bytes anywhere."""
    return mix((p[ends] - p[starts]) * powers(len(p))[1][starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


class Block:
    """Some whole documents as one byte array; words are runs of other bytes than 0x20 and 0x09-0x0D."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, rows: slice):
        self.buf, self.offs, self.rows, self.n = buf, offs, rows, len(offs) - 1

    def words(self, outside: np.ndarray = SPACE, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends and the index of each document's first word (n + 1 long).

        outside: the bytes that are in no word; breaks: flags of bytes (not the first) that begin a word in any case."""
        n = len(self.buf)
        full = ~outside[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[:1], after[-1:] = True, True
        before[1:], after[:-1] = ~full[:-1], ~full[1:]
        if breaks is not None:
            before[1:] |= breaks[1:]
            after[:-1] |= breaks[1:]
        starts = np.flatnonzero(full & (before | edge[:-1]))
        ends = np.flatnonzero(full & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each document has."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the index of each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES, lower: bool = False):
    """Cut an Arrow string column into Blocks of whole documents, at most limit bytes unless one document is longer; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        buf = raw[offs[i] : offs[j]]
        yield Block(LOWER[buf] if lower else buf, offs[i : j + 1] - offs[i], slice(i, j))
        i = j


def crc_mod(col: str, m: int):
    """crc32 of the number as text, modulo m (null: taken as the text '')."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def multi_arange(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """concatenate(arange(s, s + c) for each s, c)."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep].astype(np.int64), counts[keep]
    at = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)
