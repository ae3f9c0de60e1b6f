"""Exact removal of repeated passages with two-stage suffix arrays.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. A suffix array of
all texts would have to be in one place, so bytes are dealt to tasks by their content first, and
every task sorts the suffixes of what it gets; which windows repeat is read off the common prefixes
of neighbours in that order, and nowhere else.

1. Every window of LENGTH bytes has an anchor, the GRAM-byte string in it with the smallest hash.
   Equal windows have equal anchors in equal places, so equal windows are among the windows of
   equal anchors. The windows of an anchor are one run; its bytes are its surroundings. Anchors
   that occur once are done.
2. Occurrences with the same anchor and the same surroundings are alike: two of them are read back
   from two texts (from one, if all are copies of one text), and what is found for them holds for
   all. So copies never multiply the bytes to sort.
3. All surroundings of an anchor meet in one task. It builds the suffix array of their bytes in two
   stages: suffixes that are smaller than their successors are sorted directly, the others induced.
   Windows whose neighbours have LENGTH bytes in common repeat.
4. An anchor with more than SHARE different surroundings is dealt once more, by longer strings: the
   bytes that BLOCKS[0] neighbouring windows have in common, in the place that they have to the
   anchor, and if that is not enough by whole windows. Equal windows stay together at each level.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Substrings, mix, only, pieces, slices, text_hash, unused, utf8, written

LENGTH, GRAM = 200, 40
CHUNK, SEGMENT = 1 << 20, 1 << 23
#: Different surroundings of one anchor that a task takes, and snippets that it takes of all anchors.
SHARE, TOGETHER = 2048, 4096
#: Neighbouring windows that are dealt together at the levels after the first.
BLOCKS = (8, 1)
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside texts that lie end to end in ``data``: for each the first
    window's start, the number of further windows, the anchor's distance from the first window's
    start, its hash and its surroundings' hash."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sub = Substrings(data)
    grams = sub.grams(gram)
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, have = length - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    start = np.arange(len(low))
    text = np.searchsorted(ends, start, "right")
    ok = start + length <= ends[np.minimum(text, len(ends) - 1)]
    start, text = start[ok], text[ok]
    if not len(start):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    at = (low[ok] & _PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    first, last, at = start[new], start[np.append(new[1:], len(start)) - 1], at[new]
    around = mix(sub(first, last + length) ^ mix((at - first).astype(np.uint64) + np.uint64(1)))
    return first, last - first, at - first, grams[at], around


def _words(text: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from each place of ``text`` on, and of ``beyond`` zeros after it."""
    padded = np.concatenate([text, np.zeros(beyond + 8, np.uint8)])
    return np.ndarray(len(text) + beyond, "<u8", padded.data, strides=(1,))


def suffix_array(text: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of ``text`` in order of their first ``depth`` bytes, by two-stage sorting; if
    ``wanted`` marks places, only the suffixes there and those that induce them.

    Suffixes that are smaller than their successors are sorted directly. The others follow from
    them: the buckets of first bytes are scanned in order, and every suffix met puts the one that
    starts a byte earlier, if it is one of the others, next in the front of its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.append(np.diff(text.astype(np.int16)), -1)  # the last suffix is larger than the empty one
    place = np.arange(n)
    change = np.where(step != 0, place, n)
    small = step[np.minimum.accumulate(change[::-1])[::-1]] > 0
    if wanted is None:
        used = np.ones(n, bool)
    else:  # a suffix that is not small is induced by its successor: all up to the next small one
        before = np.maximum.accumulate(np.where(small, place, -1))
        before = np.append(-1, before[:-1])
        asked = np.append(0, np.cumsum(wanted))
        used = asked[1:] > asked[before + 1]

    # Stage one: direct sorting, by eight bytes at once and then what is tied by whole strings.
    direct = np.flatnonzero(small & used)
    words = _words(text, depth + 8)
    word = words[direct].byteswap()
    order = np.argsort(word, kind="stable")
    direct, word = direct[order], word[order]
    same = np.append(False, word[1:] == word[:-1]) if len(word) else np.zeros(0, bool)
    unlike = np.flatnonzero(same)
    unlike = unlike[_common(words, direct[unlike - 1], direct[unlike], depth) < depth]
    group = np.cumsum(~same) - 1
    tied = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    tied[group[unlike]] = True  # the others are equal to the depth
    size = np.bincount(group, minlength=len(tied))
    begin = np.cumsum(size) - size
    data = text.tobytes()
    for a, k in zip(begin[tied].tolist(), size[tied].tolist(), strict=True):
        direct[a : a + k] = sorted(direct[a : a + k].tolist(), key=lambda i: data[i + 8 : i + depth])

    # Stage two: bucket scans.
    sizes = np.bincount(text[used], minlength=256)
    start = np.concatenate([[0], np.cumsum(sizes)])
    head = start[:-1].copy()
    front = head + np.bincount(text[used & ~small], minlength=256)
    induced = used & ~small
    out = np.empty(start[-1], np.int64)
    where = np.concatenate([[0], np.cumsum(np.bincount(text[direct], minlength=256))])
    for c in np.flatnonzero(sizes):
        out[front[c] : start[c + 1]] = direct[where[c] : where[c + 1]]
    if used[n - 1]:
        out[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
    for c in np.flatnonzero(sizes).tolist():
        at = start[c]
        while at < head[c]:  # suffixes of this bucket bring in others of it
            before = out[at : head[c]] - 1
            at = head[c]
            before = before[before >= 0]
            before = before[(text[before] == c) & induced[before]]
            out[at : at + len(before)] = before
            head[c] += len(before)
        before = out[start[c] : start[c + 1]] - 1
        before = before[before >= 0]
        before = before[(text[before] > c) & induced[before]]
        before = before[np.argsort(text[before], kind="stable")]
        first = text[before]
        edges = np.flatnonzero(np.diff(first, prepend=-1 if len(first) else 0, append=256 if len(first) else 0).astype(np.int32)) if len(first) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True) if len(first) else ():
            x = first[a]
            out[head[x] : head[x] + b - a] = before[a:b]
            head[x] += b - a
    return out


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, up to ``most``."""
    out = np.full(len(a), most, np.int64)
    going = np.arange(len(a))
    for k in range(0, most, 8):
        x = words[a + k] ^ words[b + k]
        if (other := x != 0).any():
            low = x[other] & (~x[other] + np.uint64(1))
            out[going[other]] = k + (np.frexp(low.astype(np.float64))[1] - 1) // 8
            a, b, going = a[~other], b[~other], going[~other]
        if not len(going):
            break
    return np.minimum(out, most)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Lengths of the common prefixes of neighbours in ``order``, up to ``most``."""
    return _common(_words(text, most + 8), order[:-1], order[1:], most)


def equal_windows(snippets: list[bytes], windows: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of snippets: the snippet, the offset in it and the class of equal windows. A
    snippet has ``windows[i]`` windows; those of ``length`` bytes from its first bytes on."""
    text = np.frombuffer(b"".join(snippets), np.uint8)
    sizes = np.array([len(s) for s in snippets], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(snippets)), sizes)
    offset = np.arange(len(text)) - begin[owner]
    valid = offset < np.array(windows, np.int64)[owner]
    order = suffix_array(text, length, valid)
    order = order[valid[order]]
    new = np.append(True, common_prefixes(text, order, length) < length)
    return owner[order], offset[order], np.cumsum(new) - 1


def _keyed(df: DataFrame, text: str, ta: str = "ta", tb: str = "tb") -> DataFrame:
    """A text's identity: two hashes. What goes from a text depends on the text alone."""
    return df.withColumn(ta, text_hash(text)).withColumn(tb, F.xxhash64(F.lit(11), F.col(text)))


_SEEN = ["ta", "tb", "p", "more", "lead", "anchor", "around"]
_SEEN_KINDS = "ta long, tb long, p int, more int, lead int, anchor long, around long"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """The anchors of all windows of ``docs`` (ta, tb, text): a row for each run of windows."""

    def run(batches):
        for b in batches:
            ta, tb = b.column("ta").to_numpy(), b.column("tb").to_numpy()
            data, offsets = utf8(b.column("text"))
            for i, j in pieces(offsets, CHUNK):
                whole = data[offsets[i] : offsets[j]]
                ends = offsets[i + 1 : j + 1] - offsets[i]
                for s in range(0, max(1, len(whole)), SEGMENT):  # only a text by itself has more than one
                    part = whole[s : s + SEGMENT + length - 1]
                    first, more, lead, anchor, around = anchors(part, np.minimum(ends, len(part)) if j - i > 1 else np.array([len(part)]), length)
                    row = i + np.searchsorted(ends, first + s, "right")
                    p = first + s - (offsets[row] - offsets[i])
                    yield pa.RecordBatch.from_arrays([pa.array(ta[row]), pa.array(tb[row]), pa.array(p.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64))], _SEEN)

    return docs.select("ta", "tb", "text").mapInArrow(run, _SEEN_KINDS).withColumn("n", F.lit(1).cast("long"))


def _asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``text, asks``: the texts that ``asked`` (ta, tb, ask) wants something of, each once."""
    texts = docs.groupBy("ta", "tb").agg(F.first("text").alias("text"))  # copies meet as one before the join
    return texts.join(asked.groupBy("ta", "tb").agg(F.collect_list("ask").alias("asks")), ["ta", "tb"]).select("ta", "tb", "text", "asks")


_CUT = ["part", "anchor", "around", "more", "lead", "weight", "main", "again", "bytes"]


def _snippets(wanted: DataFrame, length: int) -> DataFrame:
    def cut(batches):
        for b in slices(batches):
            rows = []
            for text, asks in zip(b.column("text").to_pylist(), b.column("asks").to_pylist(), strict=True):
                data = text.encode() if isinstance(text, str) else text or b""
                rows += [(*[a[c] for c in _CUT[:-1]], data[a["p"] : a["p"] + a["more"] + length]) for a in asks]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_CUT)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _CUT)

    return wanted.mapInArrow(cut, "part int, anchor long, around long, more int, lead int, weight long, main boolean, again boolean, bytes binary")


def _blocks(around: DataFrame, length: int, block: int) -> DataFrame:
    """Rows like those of :func:`_anchor_rows` for blocks of windows of surroundings (``ta, tb``:
    their anchor and hash): the anchor is what the block's windows have in common, with the first
    anchor and the place to it."""

    def run(batches):
        for b in batches:
            ta, tb, more, lead, n = (b.column(c).to_numpy().astype(np.int64) for c in ("ta", "tb", "more", "lead", "n"))
            data, offsets = utf8(b.column("text"))
            sub, offsets = Substrings(data[offsets[0] : offsets[-1]]), offsets - offsets[0]
            low = (lead - more) // block
            count = lead // block - low + 1
            i = np.repeat(np.arange(len(ta)), count)
            nr = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            core = lead[i] - block * nr
            first, last = np.maximum(0, core - block + 1), np.minimum(more[i], core)
            name = mix(mix(ta[i].view(np.uint64)) ^ mix(nr.astype(np.uint64) + np.uint64(1)))
            name = mix(sub(offsets[i] + core, offsets[i] + core + length - block + 1) ^ name)
            whole = mix(sub(offsets[i] + first, offsets[i] + last + length) ^ mix((core - first).astype(np.uint64) + np.uint64(1)))
            columns = (ta[i], tb[i], first, last - first, core - first, name.view(np.int64), whole.view(np.int64), n[i])
            kinds = [np.int64] * 2 + [np.int32] * 3 + [np.int64] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], [*_SEEN, "n"])

    return around.mapInArrow(run, _SEEN_KINDS + ", n long")


def _repeats(docs: DataFrame, seen: DataFrame, length: int, level: int = 0) -> DataFrame:
    """``ta, tb, first, past``: the byte ranges of ``docs`` (ta, tb, text) whose windows repeat.
    ``seen`` are their anchors (``n``: the number of places that a row stands for)."""
    dup = written(seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))  # so that the join below deals both sides anew, and skewed keys can be split
    met = written(seen.join(dup, "anchor"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.first, F.last) for c in ("ta", "tb", "p")]
    kinds = written(met.groupBy("anchor", "around").agg(F.sum("n").alias("n"), F.first("more").alias("more"), F.first("lead").alias("lead"), *ends))
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > (SHARE if level < len(BLOCKS) else 1 << 60)).select("anchor", F.lit(True).alias("again"))
    many = written(many)

    # Two occurrences of each kind; if they lie in copies of one text, one that counts twice. Of
    # an anchor that is dealt again one.
    apart = ~reduce(lambda x, c: x & (F.col(f"first_{c}") == F.col(f"last_{c}")), ("ta", "tb", "p"), F.lit(True))
    again = F.coalesce("again", F.lit(False))
    parts = F.lit(max(1, math.ceil(2 * kinds.count() / TOGETHER)))
    part = F.when(again, F.pmod(F.xxhash64("anchor", "around"), parts)).otherwise(F.pmod(F.xxhash64("anchor"), parts)).cast("int").alias("part")

    def one(end: str, weight, main: bool):
        ask = F.struct(F.col(f"{end}_p").alias("p"), part, "anchor", "around", "more", "lead", weight.cast("long").alias("weight"), F.lit(main).alias("main"), again.alias("again"))
        return F.struct(F.col(f"{end}_ta").alias("ta"), F.col(f"{end}_tb").alias("tb"), ask.alias("ask"))

    both = F.array(one("first", F.lit(1), True), one("last", F.lit(1), False))
    places = F.when(again, F.array(one("first", F.col("n"), True))).when(apart, both).otherwise(F.array(one("first", F.least("n", F.lit(2)), True)))
    snippets = _snippets(_asked(docs, kinds.join(many, "anchor", "left").select(F.inline(places))), length)

    def match(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        later = table.filter(table.column("again")).select(["anchor", "around", "more", "lead", "weight", "bytes"])
        table = table.filter(pc.invert(table.column("again")))
        anchor, around, more, weight, main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "around", "more", "weight", "main"))
        owner, offset, kind = equal_windows(table.column("bytes").to_pylist(), (more + 1).tolist(), length)
        twice = np.bincount(kind, weight[owner])[kind] > 1
        use = np.flatnonzero(twice & main[owner])
        use = use[np.lexsort((offset[use], owner[use]))]
        o, w = owner[use], offset[use]
        new = np.flatnonzero((np.diff(o, prepend=-1) != 0) | (np.diff(w, prepend=-2) != 1))
        stop = np.append(new[1:], len(o)) - 1 if len(new) else new
        columns = (anchor[o[new]], around[o[new]], w[new].astype(np.int32), (w[stop] + length).astype(np.int32))
        found = pa.table([pa.array(c) for c in columns], ["anchor", "around", "a", "b"])
        out = pa.concat_tables([found, later], promote_options="default")
        return out.select(["anchor", "around", "a", "b", "more", "lead", "weight", "bytes"])

    found = written(snippets.groupBy("part").applyInArrow(match, "anchor long, around long, a int, b int, more int, lead int, weight long, bytes binary"))
    ranges = found.where("bytes is null").select("anchor", "around", "a", "b")
    if level < len(BLOCKS) and not many.isEmpty():
        later = found.where("bytes is not null").selectExpr("anchor as ta", "around as tb", "more", "lead", "weight as n", "bytes as text")
        ranges = ranges.unionAll(written(_repeats(later, _blocks(later, length, BLOCKS[level]), length, level + 1)))
    return met.join(ranges, ["anchor", "around"]).select("ta", "tb", (F.col("p") + F.col("a")).alias("first"), (F.col("p") + F.col("b")).alias("past")).distinct()


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``ta, tb, spans``: the bytes to remove from each text of ``docs`` (ta, tb, text), as
    unordered and possibly overlapping byte ranges (first, past). Texts without any are left out;
    rows of equal texts have one row here."""
    found = _repeats(docs, _anchor_rows(docs, length), length)
    return found.groupBy("ta", "tb").agg(F.collect_list(F.struct("first", "past")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["past"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def rest(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in gone:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, removed, kept`` for every document: the UTF-8 bytes of the
    whole text without each byte that is covered by a string of ``length`` bytes that also starts
    anywhere else (in the same text too), the removed byte ranges (maximal runs), and what is kept.

    A null text is an empty one. Rows are texts of their own: of repeated rows every byte repeats.
    Texts of any length are taken whole. Ids may be null; an empty table gives an empty result.
    Other columns, whatever their names, are ignored.
    """
    docs = _keyed(only(df, doc_id=doc_id, text=text), "text")
    kind = df.schema[doc_id].dataType.simpleString()
    removed = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def apply(batches):
        for b in slices(batches):
            n, gone, runs, kept = [], [], [], []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data, cut = (t or "").encode(), merged(s)
                n.append(len(data))
                gone.append(sum(e - a for a, e in cut))
                runs.append([{"first": a, "past": e} for a, e in cut])
                kept.append(rest(data, cut))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, removed), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    both = docs.join(spans(docs, length), ["ta", "tb"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<first:int,past:int>>, kept binary")


def strip(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with the repeated passages gone from ``text``. A character stays if only some of its
    bytes are to go. A null text stays null; texts of which nothing is left are empty. Every row
    stays, repeated ones too; an empty table stays empty. Other columns stay as they are, whatever
    their names."""
    names, (ta, tb, gone) = df.columns, unused(df, "ta", "tb", "spans")
    docs = _keyed(df, text, ta, tb)

    def apply(batches):
        for b in slices(batches, text):
            out = []
            for t, s in zip(b.column(text).to_pylist(), b.column(gone).to_pylist(), strict=True):
                if t and s:
                    data, cut = t.encode(), []
                    for first, past in merged(s):
                        while first < past and data[first] & 0xC0 == 0x80:  # inside a character
                            first += 1
                        while past > first and past < len(data) and data[past] & 0xC0 == 0x80:
                            past -= 1
                        cut.append((first, past))
                    t = rest(data, cut).decode()
                out.append(t)
            columns = [pa.array(out, b.schema.field(c).type) if c == text else b.column(b.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    found = spans(docs.select(F.col(ta).alias("ta"), F.col(tb).alias("tb"), F.col(text).alias("text")), length).toDF(ta, tb, gone)
    return docs.join(found, [ta, tb], "left").select(*[f"`{c}`" for c in names], gone).mapInArrow(apply, df.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document with what is removed and a digest of what is kept."""
    d = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window by its place, in hexadecimal: first cut into blocks, so that long texts are not walked again for each.
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, length(h) // 2 AS n, o, substr(h, 2 * o + 1, {2 * (256 + LENGTH)}) AS piece FROM (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0), 256)) AS o FROM d)),
w AS (SELECT r, o + k AS p, md5(substr(piece, 2 * k + 1, {2 * LENGTH})) AS m FROM (SELECT *, unnest(range(256)) AS k FROM b) WHERE o + k + {LENGTH} <= n),
c AS (SELECT r, p FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM c)),
g AS (SELECT r, min(p) AS a, max(p) + {LENGTH} AS b FROM i GROUP BY r, run),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM g),
s AS (SELECT k.r, sum(b - a) AS gone, count(*) AS runs, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM k JOIN d USING (r) GROUP BY k.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""
