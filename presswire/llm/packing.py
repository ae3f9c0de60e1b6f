"""Sequence packing: variable-capacity best-fit decreasing."""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, text_hash, written
from .vocabulary import MULTI, tiktoken_encoding

CAPACITIES = (1024, 2048, 4096, 8192)
#: Pieces that one task packs. Bins hold pieces of one such group only.
GROUP_PIECES = 20_000
#: Cost of a sequence of c tokens: PER_SEQUENCE + c + c * c / QUADRATIC.
PER_SEQUENCE, QUADRATIC = 64.0, 65_536.0


def cost(c: int) -> float:
    """What training on a sequence of ``c`` tokens costs, in tokens: a fixed part, a linear
    part and the quadratic part of attention."""
    return PER_SEQUENCE + c + c * c / QUADRATIC


def _filled(n: int, capacity: int, left: list[int], present: int) -> int:
    """Tokens of a bin of ``capacity`` that opens for ``n`` tokens and is filled from the lengths
    that are ``left`` (how many of each; the bits of ``present`` tell which), longest first."""
    at, taken, last = n, 0, 0
    while room := capacity - at:
        fits = present & ((2 << room) - 1)
        if not fits:
            break
        x = fits.bit_length() - 1
        taken = taken + 1 if x == last else 1
        last = x
        if taken >= left[x]:  # no more of this length
            present &= ~(1 << x)
            at += x
            continue
        more = min(left[x] - taken, (room - x) // x)
        taken += more
        at += x * (1 + more)
        if taken >= left[x]:
            present &= ~(1 << x)
    return at


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, its offset there, and the capacity of each bin.

    ``lengths`` come in falling order. A piece goes to the open bin with the least room that
    still holds it. If there is none, a bin opens, and the permitted sizes are weighed together:
    each is filled, longest first, with the lengths that are left to pack, and the one with the
    least cost for each token that it would hold, at the size that it would shrink to, is opened.
    At the end every bin shrinks to the smallest permitted size that holds its contents.
    """
    caps = sorted(capacities)
    left = [0] * (caps[-1] + 1)
    for n in lengths:
        left[n] += 1
    present = sum(1 << n for n in set(lengths))  # the lengths that are left
    room: dict[int, list[int]] = defaultdict(list)
    open_ = 0  # bit r is set if a bin has room for r tokens
    bins, offsets, used, size = [], [], [], []

    def each(n: int, c: int) -> tuple[float, int]:
        full = _filled(n, c, left, present)
        return cost(next(x for x in caps if x >= full)) / full, c

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r = min(each(n, c) for c in caps if c >= n)[1]
            b = len(used)
            used.append(0)
            size.append(r)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if r > n:
            room[r - n].append(b)
            open_ |= 1 << (r - n)
    return bins, offsets, [next(c for c in caps if c >= u) for u in used]


def token_counts(df: DataFrame) -> DataFrame:
    """``doc_id, text`` to ``doc_id, tie, n_tokens`` with a separator token for each document."""

    def count(batches):
        enc = tiktoken_encoding(MULTI)
        for b in slices(batches):
            n = [1 + (len(enc.encode_ordinary(t)) if t else 0) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(n, pa.int64())], ["doc_id", "tie", "n_tokens"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.withColumn("tie", text_hash()).mapInArrow(count, f"doc_id {kind}, tie long, n_tokens long")


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document of ``df`` into sequences of permitted lengths.

    Returns a row for each piece: ``doc_id, piece, first_token, n_tokens, grp, bin, bin_offset,
    capacity``. A document has its tokens (byte-level BPE) and one separator, so null and empty
    texts are pieces of one token. A document longer than the largest capacity, however long, is
    cut into pieces of that capacity and a rest; nothing is dropped. Repeated rows are packed as often as they
    occur; ids may be null; pieces of equal length come in the order of id and text hash. An empty
    table gives an empty result. Pieces are dealt evenly over groups of about ``group_pieces``, and
    each group is packed by itself: a bin is ``(grp, bin)``. Other columns, whatever their names,
    are ignored.
    """
    most = max(capacities)
    lengths = token_counts(only(df, doc_id=doc_id, text=text))
    cut = lengths.select("doc_id", "tie", "n_tokens", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {most})")).alias("piece")).select(
        "doc_id", "tie", "piece", (F.col("piece") * most).alias("first_token"), F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).cast("long").alias("n_tokens")
    )
    cut = written(cut)
    groups = max(1, math.ceil(cut.count() / group_pieces))
    # The table is written, so a row keeps its number; even one row repeated without end is dealt evenly.
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    kind = df.schema[doc_id].dataType.simpleString()

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("tie", "ascending"), ("piece", "ascending")])
        bins, offsets, size = best_fit(t.column("n_tokens").to_pylist(), capacities)
        out = t.select(["doc_id", "piece", "first_token", "n_tokens", "grp"])
        for name, values, arrow in (("bin", bins, pa.int32()), ("bin_offset", offsets, pa.int64()), ("capacity", [size[b] for b in bins], pa.int32())):
            out = out.append_column(name, pa.array(values, arrow))
        return out

    return dealt.groupBy("grp").applyInArrow(fit, f"doc_id {kind}, piece long, first_token long, n_tokens long, grp int, bin int, bin_offset long, capacity int")


def op4(spark, sf_dir: str) -> DataFrame:
    """Every document packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
