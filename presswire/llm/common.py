"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of the tables that operators of this process have written and not discarded.
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints. ``spark.checkpoint.dir`` names it on a cluster, where a folder
    of one machine would lose what the others write: without the setting this fails there. A
    folder of this machine is used only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="presswire-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there, so
    a lost executor costs the tasks it ran and not what came before. Unlike ``checkpoint()``
    it stores columns compressed. The table stays until :func:`discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *more: str) -> None:
    """Delete the tables that operators have written so far, and the paths ``more``. Results that
    still read them must have been written or collected before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in [*_tables, *more]:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    _tables.clear()


def dropping(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without columns named (in any case) like one of ``names``: an output column
    replaces an input column of its name. ``keep`` are columns that must not clash."""
    lower = {n.lower() for n in names}
    if bad := [k for k in keep if k.lower() in lower]:
        raise ValueError(f"reserved column names: {bad}")
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` is named so in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the names wanted: other columns cannot clash."""
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column of an Arrow batch and its n + 1 offsets; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text makes a range of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def slices(batches, text: str = "text", most: int = 1 << 22):
    """``batches`` cut into smaller ones of about ``most`` bytes of text, so that few texts are
    Python objects at a time; a longer text is one by itself."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.names.index(text))), 0).to_numpy(zero_copy_only=False)
        for i, j in pieces(np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]), most):
            yield b.slice(i, j - i)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Substrings:
    """64-bit hashes of any substring of ``data`` in constant time (prefix sums of a
    polynomial with a random value for each byte, modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all substrings of ``k`` bytes, by their start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_hash(column: str = "text"):
    """A hash of the text that tells null from empty."""
    return F.xxhash64(F.col(column), F.col(column).isNull())
