"""HTTP fetching: a data source of URLs, and a fetch of a table of requests.

The transport is a function from URL and timeout to text, so tests need no network.
"""

from __future__ import annotations

import logging
import math
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import url_key

#: Requests under way at once over the whole job, at least and at most; tries after the first;
#: seconds for each try, from its start to the last byte.
LEAST, CONCURRENCY, RETRIES, TIMEOUT = 20, 50, 1, 30.0

log = logging.getLogger(__name__)

Transport = Callable[[str, float], str]


def urlopen(url: str, timeout: float) -> str:
    end = time.monotonic() + timeout
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        parts = []
        while part := r.read1(1 << 16):
            parts.append(part)
            if time.monotonic() > end:
                raise TimeoutError(f"no end after {timeout:g} s")
        return b"".join(parts).decode(r.headers.get_content_charset() or "utf-8", "replace")


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:  # noqa: S310
        return r.read().decode()


def workers(tasks: int) -> int:
    """Requests that one of ``tasks`` tasks has under way at once."""
    return max(1, math.ceil(LEAST / tasks), CONCURRENCY // tasks)


def get(url: str, transport: Transport = urlopen, retries: int = RETRIES, timeout: float = TIMEOUT) -> tuple[str | None, str | None]:
    """The body, or the last error after all tries."""
    error = None
    for _ in range(retries + 1):
        try:
            return transport(url, timeout), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    log.warning("%s failed: %s", url, error)
    return None, error


def source(transport: Transport = urlopen, name: str = "presswire_http") -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(source())``, then
    ``spark.read.format(name).option("urls", "...\\n...").load()`` gives ``url, body, error``."""

    class Batch(InputPartition):
        def __init__(self, urls: list[str]):
            self.urls = urls

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
            self.parts = int(options.get("partitions", "8"))

        def partitions(self):
            n = max(1, min(self.parts, len(self.urls)))
            return [Batch(self.urls[i::n]) for i in range(n)]

        def read(self, partition):
            with ThreadPoolExecutor(workers(self.parts)) as pool:
                for url, (body, error) in zip(partition.urls, pool.map(lambda u: get(u, transport), partition.urls), strict=True):
                    yield url, body, error

    class Http(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "url string, body string, error string"

        def reader(self, schema):
            return Reader(self.options)

    return Http


def fetch(requests: DataFrame, transport: Transport = urlopen, tasks: int = 10, url: str = "url", to: str = "html") -> DataFrame:
    """``requests`` with the body of their URL in ``to`` and ``error``; one request for each URL
    key. Filter before, and write or persist the result if it is used twice."""
    once = requests.withColumn("__key", url_key(F.col(url))).dropDuplicates(["__key"]).drop("__key").repartition(tasks)
    names = once.columns
    schema = once.withColumn(to, F.lit("").cast("string")).withColumn("error", F.lit("").cast("string")).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers(tasks)) as pool:
            for b in batches:
                got = list(pool.map(lambda u: get(u, transport), b.column(url).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*names, to, "error"])

    return once.mapInArrow(run, schema)


def split_failures(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was fetched, and the quarantine of what failed."""
    return fetched.where("error is null").drop("error"), fetched.where("error is not null")
