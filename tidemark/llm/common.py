"""What the text operators share: tables kept in the shared folder, and word splitting on Arrow buffers.

Words are runs of bytes other than space and the controls 9 to 13. These separators are ASCII, so that the UTF-8
bytes of a batch can be split as they are, without decoding a text.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, on a local master only, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all its nodes share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: its lineage ends there, and lost executors cost no recomputation. Once it is
    written, what was shuffled for it is of no more use and is removed, where the session knows that setting."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the table by which rows are told apart before a shuffle; as bytes, what each task holds of it.
MARK_BITS = 1 << 24
_PAGE_BITS = 1 << 15


def marked_rows(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key may be among the wanted ones: those of a bit that one of these has set, in a table of MARK_BITS bits (2 MB, whatever
    the number of keys) that goes to every task. An exact join is to follow; what this drops it need not move."""
    place = F.pmod(F.col(wanted_key), F.lit(MARK_BITS))
    pages = wanted.select(F.floor(place / _PAGE_BITS).cast("int").alias("_page"), (place % _PAGE_BITS).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    own = F.pmod(F.col(key), F.lit(MARK_BITS))
    bit = (own % _PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(pages), F.floor(own / _PAGE_BITS).cast("int") == F.col("_page"))
    return met.where(F.getbit(byte, bit % 8) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_of(ids: list, n: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % n for x in ids], np.int64)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text each."""
    ends = np.cumsum(lengths(column))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes one after another, and where each begins (with the end as last entry)."""
    n = lengths(column)
    at = np.concatenate([[0], np.cumsum(n)])
    if not at[-1]:
        return np.zeros(0, np.uint8), at
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)
    if int(off[-1]) - int(off[0]) == at[-1]:
        return raw[off[0] : off[-1]], at
    return np.concatenate([raw[off[i] : off[i] + n[i]] for i in range(len(n))]), at


class Words:
    """The words of some texts: data[off[i]:off[i+1]] is word i, words doc[d] to doc[d+1] are those of text d."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, at = text_bytes(column)
        inside = ~SEPARATORS[raw]
        begins = inside.copy()
        if len(raw):
            begins[1:] &= ~inside[:-1]
            first = at[:-1][at[:-1] < at[1:]]
            begins[first] = inside[first]
        self.begins = np.flatnonzero(begins)
        self.doc = np.searchsorted(self.begins, at)
        data = raw[inside]
        self.data = LOWER[data] if lower else data
        self.off = np.concatenate([np.cumsum(inside, dtype=np.int64)[self.begins] - 1, [len(data)]]).astype(np.int64)
        self.raw, self.at = raw, at

    def __len__(self) -> int:
        return len(self.off) - 1

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.off), pa.py_buffer(self.data)])

    def per_doc(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), self.per_doc())

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.off)


TABLE = np.random.default_rng(20240611).integers(0, 2**63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(4096)], np.uint64)


def byte_hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[off[i]:off[i+1]], by tabulation over the place and the byte."""
    n = np.diff(off)
    if not len(n):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(off[:-1], n)
    value = TABLE[place & 63, data]
    if len(n) and n.max() > 64:
        value *= _POWERS[(place >> 6) & 4095]
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(value, off[:-1][full])
    return mix(out + n.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, one to one on 64 bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's windows of `size` words, and where each text's begin. A text of
    fewer words has one, of the whole sequence; a text without words has none."""
    h, doc = words.hashes(), words.doc
    n = np.diff(doc)
    parts = [np.uint64((2 * i + 1) * 0xD6E8FEB86659FD93 % 2**64) for i in range(size)]
    many = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), many)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + doc[owner] if len(owner) else np.zeros(0, np.int64)
    total = np.zeros(len(owner), np.uint64)
    for i in range(size):
        at = first + i
        have = at < doc[owner + 1] if len(owner) else np.zeros(0, bool)
        total[have] += mix(h[at[have]] + parts[i])
    total = mix(total + np.minimum(n[owner], size).astype(np.uint64))
    if not len(total):
        return total, np.zeros(len(n) + 1, np.int64)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[new], np.searchsorted(owner[new], np.arange(len(n) + 1))
