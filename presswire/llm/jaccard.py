"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed word shingles, and sets become MinHash signatures, in which two sets
agree in a coordinate with the probability of their Jaccard similarity. A run starts with all
sets in one bucket. A bucket picks coordinates by a hash of its own path, the same for all its
sets, and hands a set on to the child bucket of each picked coordinate's value: sets that share
the sampled token stay together. A bucket that is small, or that hardly shrinks because its sets
are alike, is compared by brute force: signatures tell which pairs can be links, and these are
decided on the full sets. Runs repeat until the target recall.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Substrings, mix, only, pieces, text_hash, unused, utf8, written
from .components import components, of_class, seen_before, stars

WORDS = 5
#: Similarity as a fraction, so that the comparison is exact: 4/5.
NUMERATOR, DENOMINATOR = 4, 5
COORDINATES = 64
#: Coordinates that a bucket picks.
BRANCHES = 2
RECALL = 0.9999
#: Buckets of so many sets or fewer are compared by brute force; larger ones are split at most so often.
SMALL, LEVELS = 256, 8
#: Splitting ends when all buckets that are left make so many pairs or fewer: to compare them costs
#: less than another shuffle.
PAIRS = 1 << 25
#: Sets that agree with one of their bucket in this share of coordinates on average, as far as
#: PROBED of them show, are alike, and splitting won't part them.
ALIKE, PROBED = 0.5, 16
#: Coordinates in which signatures must agree for a pair to be compared: a pair at the threshold,
#: which agrees in 51 on average, agrees in fewer with a probability of about 1e-6.
AGREE = 35
#: Sets, and bytes of sets, in a block on average; larger buckets are compared block against block.
#: Signatures are small: blocks of large sets are compared by them several at once.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _RNG.integers(0, 1 << 62, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)
_PLACE = _RNG.integers(0, 1 << 62, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def runs_needed(recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met in a smallest bucket with this
    probability. A pair survives a level if it agrees in a picked coordinate whose bucket it
    survives, so the chance q of any depth solves q = 1 - (1 - s q)**BRANCHES."""
    s, q = NUMERATOR / DENOMINATOR, 1.0
    for _ in range(200):
        q = 1 - (1 - s * q) ** BRANCHES
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted hashed shingles of each text, and its number of words. Words are
    ``[^\\x20\\x09-\\x0D]+``; a text of fewer than ``k`` words has one shingle of all its words,
    one without words has none."""
    n_docs = len(offsets) - 1
    base = offsets[0]
    data, at = data[base : offsets[-1]], offsets - base
    space = _SPACE[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:-1], after[: len(data) - 1] = space[:-1], space[1:]
    before[at] = True
    after[at[at > 0] - 1] = True
    start = np.flatnonzero(~space & before[: len(data)])
    end = np.flatnonzero(~space & after[: len(data)]) + 1
    doc = np.searchsorted(at, start, "right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n_words)])
    words = Substrings(data)(start, end) if len(start) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        rolled += words[i : i + len(rolled)] * _PLACE[i]
    rolled = mix(rolled)
    sets = []
    for d, n in enumerate(n_words.tolist()):
        a = int(first[d])
        if n >= k:
            sets.append(np.unique(rolled[a : a + n - k + 1]))
        elif n:
            sets.append(mix(np.array([(words[a : a + n] * _PLACE[8 : 8 + n]).sum() + np.uint64(n)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets, n_words


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (len(sets) x COORDINATES) of non-empty sets."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    if sets:
        flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for i in range(COORDINATES):
            out[:, i] = np.minimum.reduceat(((flat ^ _ADD[i]) * _MULTIPLY[i]) >> np.uint64(32), start)
    return out


def children(node: np.ndarray, signature: np.ndarray) -> np.ndarray:
    """The BRANCHES child buckets of each set in its bucket, by the set's signature."""
    out = np.zeros((len(node), BRANCHES), np.uint64)
    picked = mix(node + np.uint64(1)) % np.uint64(COORDINATES)
    step = mix(node + np.uint64(2)) % np.uint64(COORDINATES - 1) + np.uint64(1)
    rows = np.arange(len(node))
    for k in range(BRANCHES):
        value = signature[rows, picked.astype(np.int64)].astype(np.uint64)
        out[:, k] = mix(mix(node + picked) ^ mix(value + np.uint64(k + 11)))
        picked = (picked + step) % np.uint64(COORDINATES)
    return out


def first_levels(signature: np.ndarray, runs: int) -> np.ndarray:
    """The buckets two levels below the roots of all runs; roots pick different coordinates."""
    picked = np.random.Generator(np.random.PCG64(5)).permutation(COORDINATES)[: runs * BRANCHES]
    node = mix(mix(signature[:, picked].astype(np.uint64)) + np.arange(1, len(picked) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    below = [children(node[:, i], signature) for i in range(node.shape[1])]
    return np.ascontiguousarray(np.concatenate(below, axis=1)) if below else node


def _sets_of(df: DataFrame, runs: int) -> DataFrame:
    """``doc_id, th, text`` to ``doc_id, th, key, shingles, signature, nodes``: the key names the
    set, ``shingles`` is its size."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in pieces(offsets, CHUNK):
                sets, _ = shingle_sets(data, offsets[i : j + 1])
                full = [s for s in sets if len(s)]
                sig = signatures(full)
                nodes = first_levels(sig, runs).view(np.int64)
                at, keys, sigs, lists = 0, [], [], []
                for s in sets:
                    if len(s):
                        keys.append(hashlib.md5(s.tobytes()).digest())
                        sigs.append(sig[at].tobytes())
                        lists.append(nodes[at])
                        at += 1
                    else:
                        keys.append(None)
                        sigs.append(None)
                        lists.append(None)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc_id", "th", "key", "shingles", "signature", "nodes"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, th long, key binary, shingles long, signature binary, nodes array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """``node, key, size, load`` of the buckets to compare (their sets, and shingles of these). Each level is one job: a node's size and one
    of its sets come from one aggregate, and what follows stays where its nodes are."""
    rows = classes.select(F.explode("nodes").alias("node"), "key", "shingles")
    total = [F.count(F.lit(1)).alias("size"), F.sum("shingles").alias("load")]
    level = written(rows.join(rows.groupBy("node").agg(*total).where("size > 1"), "node").drop("shingles"))
    leaves = [level.where(F.col("size") <= SMALL)]

    def split(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            node = children(b.column("node").to_numpy().view(np.uint64), sig).view(np.int64)
            rep = pa.array(np.repeat(np.arange(len(node)), BRANCHES))
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel()), *(b.column(c).take(rep) for c in ("key", "shingles", "signature"))], ["node", "key", "shingles", "signature"])

    part = lambda c, i: F.substring(c, 4 * i + 1, 4)
    agree = sum((part("signature", i) == part("probe", i)).cast("int") for i in range(PROBED)) / F.lit(PROBED)

    def looked_at(rows: DataFrame) -> DataFrame:
        """``rows`` (node, key, shingles, signature) of nodes of two sets or more, with the node's
        size and load and how far its sets agree with one of them."""
        rows = written(rows)  # they are read twice
        of = rows.groupBy("node").agg(*total, F.min(F.struct("key", "signature")).alias("m")).where("size > 1")
        met = rows.join(of.select("node", "size", "load", F.col("m.signature").alias("probe")), "node")
        share = met.groupBy("node").agg(F.avg(agree).alias("share"))
        return written(met.join(share, "node").select("node", "key", "shingles", "signature", "size", "load", "share"))

    def few(rows: DataFrame) -> bool:
        return (rows.agg(F.sum("size")).first()[0] or 0) <= PAIRS

    large = level.where(F.col("size") > SMALL)
    if few(large):
        leaves.append(large)
    else:
        level = looked_at(large.select("node", "key").join(classes.select("key", "shingles", "signature"), "key").select("node", "key", "shingles", "signature"))
        for depth in range(LEVELS + 1):
            done = (F.col("size") <= SMALL) | (F.col("share") >= ALIKE)
            leaves.append(level.where(done))
            large = level.where(~done)
            if depth == LEVELS or few(large):
                leaves.append(large)
                break
            level = looked_at(large.select("node", "key", "shingles", "signature").mapInArrow(split, "node long, key binary, shingles long, signature binary"))
    leaves = reduce(DataFrame.unionAll, [x.select("node", "key", "size", "load") for x in leaves])
    # Buckets of equal members do the same work: the first of them does it.
    same = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("s"), F.bit_xor(F.xxhash64(F.lit(3), "key")).alias("x"))
    return written(leaves.join(same.groupBy("n", "s", "x").agg(F.min("node").alias("node")).select("node"), "node", "left_semi"))


_CANDIDATE = pa.schema([("node", pa.int64()), ("key", pa.binary()), ("block", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])


def _candidates(table: pa.Table) -> pa.Table:
    """The rows of a bucket, or of two wide blocks of it, that may have links which no bucket of a
    smaller number finds, for each pair of blocks in which they do."""
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(table.num_rows, -1)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    block, wide = table.column("block").to_numpy(), table.column("wide").to_numpy()
    p, q = np.flatnonzero(wide == low), np.flatnonzero(wide == high)
    agree = np.zeros((len(p), len(q)), np.uint8)
    for i in range(sig.shape[1]):
        agree += sig[p, i, None] == sig[None, q, i]
    linked = _first_time(table, agree >= AGREE, p, q)
    rows, lows, highs = [], [], []
    for a in np.unique(block[p[linked.any(axis=1)]]).tolist():
        for b in np.unique(block[q]).tolist():
            if low == high and b < a:
                continue
            in_a, in_b = np.flatnonzero(block[p] == a), np.flatnonzero(block[q] == b)
            part = linked[np.ix_(in_a, in_b)]
            own = np.union1d(p[in_a[part.any(axis=1)]], q[in_b[part.any(axis=0)]])
            rows.append(own)
            lows.append(np.full(len(own), min(a, b), np.int32))
            highs.append(np.full(len(own), max(a, b), np.int32))
    if not rows:
        return _CANDIDATE.empty_table()
    out = table.select(["node", "key", "block"]).take(pa.array(np.concatenate(rows)))
    return out.append_column("low", pa.array(np.concatenate(lows))).append_column("high", pa.array(np.concatenate(highs)))


def _first_time(table: pa.Table, linked: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the links between rows ``p`` and ``q`` are no row's with itself, and not found in a
    bucket of a smaller number."""
    linked = linked & (p[:, None] != q[None, :])
    if linked.any() and (seen := seen_before(table.column("buckets").to_pylist(), table.column("node")[0].as_py(), p, q)) is not None:
        linked &= ~seen
    return linked


def _compare(table: pa.Table) -> pa.Table:
    """Links inside one bucket, or between two of its blocks: for each set with links their
    number (documents and texts) and its star's centre."""
    keys = table.column("key").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    weight = table.column("n").to_numpy()
    n = len(keys)
    sizes = np.array([len(s) for s in sets], np.int64)
    block = table.column("block").to_numpy()
    p, q = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("low", "high"))
    kind = np.float32 if sizes.max() < 1_000_000 else np.float64  # counts are exact in either
    both = np.zeros((len(p), len(q)), kind)
    if n == 2:
        both += len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        _, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        many = counts >= 2
        column, use = np.cumsum(many) - 1, many[where]
        owner, column = owner[use], column[where[use]]
        width = min(len(counts), max(1, 4_000_000 // n))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            x = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), kind)
            x[owner[a:b], column[a:b] - lo] = 1
            both += x[p] @ x[q].T
    # both / (sizes - both) >= 4 / 5, without a division
    alike = (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (sizes[p].astype(kind)[:, None] + sizes[q].astype(kind)[None, :])
    found = _first_time(table, alike, p, q)
    linked = np.zeros((n, n), bool)
    linked[np.ix_(p, q)] = found
    linked |= linked.T
    some = np.flatnonzero(linked.any(axis=1))
    label = stars(linked)
    return pa.table({"key": pa.array([keys[i] for i in some], pa.binary()), "centre": pa.array([keys[label[i]] for i in some], pa.binary()), "links": pa.array(linked[some] @ weight, pa.int64()), "texts": pa.array(linked[some].sum(axis=1), pa.int64())})


_COMPARED = pa.schema([("key", pa.binary()), ("centre", pa.binary()), ("links", pa.int64()), ("texts", pa.int64())])


def _each(rows: DataFrame, parts: int, of, schema: str, empty: pa.Schema) -> DataFrame:
    """``of`` applied to the rows of each bucket and pair of its blocks; many of them in a task."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("low", "ascending"), ("high", "ascending"), ("key", "ascending")]).combine_chunks()
        ids = np.stack([table.column(c).to_numpy() for c in ("node", "low", "high")])
        edge = np.flatnonzero((np.diff(ids, axis=1, prepend=ids[:, :1] - 1) != 0).any(axis=0)).tolist()
        out = [of(table.slice(a, b - a)) for a, b in zip(edge, [*edge[1:], table.num_rows], strict=True) if b - a > 1]
        return pa.concat_tables(out) if out else empty.empty_table()

    return rows.withColumn("part", F.pmod(F.xxhash64("node", "low", "high"), F.lit(max(1, parts))).cast("int")).groupBy("part").applyInArrow(run, schema)


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """Every document with its class of near-duplicates: ``doc_id, th, class_id, is_first,
    n_copies, n_links, n_texts``.

    Documents are linked if the Jaccard similarity of their sets of WORDS-word shingles is 0.8 or
    more. Documents with equal sets form one text; links are found between texts, so copies are
    never expanded into pairs. ``class_id`` is the smallest id that links reach, ``n_copies`` the
    number of documents with the same set, ``n_links`` the number of other documents linked
    directly, ``n_texts`` that of other texts. ``is_first`` marks the rows of one document of
    each class: the one with the smallest id, and among these with the smallest hash of the text
    (``th``). A document without words (null, empty, blank) links with nothing: it is a class of
    its own. Ids may be null (they sort first) and repeat; repeated rows are copies. Texts of any
    length are taken whole; an empty table gives an empty result. Other columns, whatever their
    names, are ignored.
    """
    docs = only(df, doc_id=doc_id, text=text).withColumn("th", text_hash())
    members = written(_sets_of(docs, runs_needed(recall)))
    classes = written(members.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("shingles").alias("shingles"), F.first("signature").alias("signature"), F.first("nodes").alias("nodes")))
    buckets = _buckets(classes)

    own = buckets.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("buckets"))
    own = written(own.join(classes.select("key", "n", "rep", "signature"), "key"))
    wide = F.ceil(F.col("size") / BLOCK).cast("int")
    each = F.greatest(F.lit(1), F.ceil(F.col("load") * 8 / BLOCK_BYTES / wide)).cast("int")  # blocks of a wide one
    rows = buckets.join(own.select("key", "buckets", "signature"), "key").withColumn("block", F.pmod(F.xxhash64("key"), wide * each).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), wide - 1))).withColumn("wide", F.floor(F.col("block") / each).cast("int"))
    rows = rows.select("node", "key", "buckets", "signature", "block", "wide", F.least("wide", "other").alias("low"), F.greatest("wide", "other").alias("high"))
    total = buckets.select(F.sum(wide)).first()[0] or 0
    near = written(_each(rows, math.ceil(total / 1024), _candidates, "node long, key binary, block int, low int, high int", _CANDIDATE))
    wanted = own.join(near.select("key").distinct(), "key", "left_semi").select("key", "n", "buckets", "rep.doc_id", "rep.th")

    def with_sets(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in pieces(offsets, CHUNK):
                sets, _ = shingle_sets(data, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, j - i), b.column("n").slice(i, j - i), b.column("buckets").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "n", "buckets", "shingles"])

    d, w = docs.alias("d"), wanted.alias("w")
    found = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))).select("key", "n", "buckets", "text")
    sets = found.mapInArrow(with_sets, "key binary, n long, buckets array<long>, shingles binary").dropDuplicates(["key"])
    rows = near.join(sets, "key").select("node", "key", "n", "buckets", "shingles", "block", "low", "high")
    links = written(_each(rows, math.ceil(near.count() / 256), _compare, "key binary, centre binary, links long, texts long", _COMPARED))

    group = components(links.select(F.col("key").alias("a"), F.col("centre").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    first = group.join(classes.select(F.col("key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
    linked = group.join(first, "component").select(F.col("node").alias("key"), "first")
    per_key = classes.select("key", "n", "rep").join(counts, "key", "left").join(linked, "key", "left")
    per_key = per_key.where("n > 1 or links is not null")  # the others are classes of one row
    per_key = per_key.select("key", "n", F.coalesce("first", "rep").alias("first"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    own = of_class(members.select("doc_id", "th", "key"), written(per_key), members.count())
    alone = F.col("first").isNull()
    own = own.select(
        "doc_id",
        "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))).alias("is_first"),
        F.coalesce("n", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )
    none = members.where("key is null").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(True).alias("is_first"), F.lit(1).alias("n_copies"), F.lit(0).alias("n_links"), F.lit(0).alias("n_texts"))
    return own.unionByName(none).select("doc_id", "th", "class_id", "is_first", *[F.col(c).cast("long").alias(c) for c in ("n_copies", "n_links", "n_texts")])


def keep(df: DataFrame, doc_id: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class of :func:`join` the first
    document stays, and of rows that share its id and text the one with the smallest hash of all
    columns. A row without words (null, empty, blank) is a class of its own, so all of these stay,
    repeated ones too. An empty table stays empty; other columns stay, whatever their names."""
    own_id, own_text, th, many, row = unused(df, "id", "own_text", "th", "many", "row")
    classes = join(df, doc_id, text, recall).where("is_first")
    first = written(classes.select(F.col("doc_id").alias(own_id), F.col("th").alias(th), (F.col("n_copies") > 1).alias(many)).distinct())
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.col(own_text) == F.col(th))
    kept = df.withColumn(own_text, text_hash(f"`{text}`")).join(first, same)
    columns = [f"`{c}`" for c in df.columns]
    hashed = [f"`{c}`" for c, kind in df.dtypes if not kind.startswith(("map", "variant", "void"))]
    least = F.min_by(F.struct(*columns), F.xxhash64(*hashed, *[F.col(c).isNull() for c in hashed])).alias(row)
    repeated = kept.where(many).groupBy(f"`{doc_id}`", own_text).agg(least).select(f"{row}.*")
    return kept.where(~F.col(many)).select(*columns).unionAll(repeated)


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document with its class and its number of links."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_copies", "n_links")
