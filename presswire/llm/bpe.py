"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Every byte prefix of a piece of text has exactly one valid encoding, and the encoding of a
prefix is that of a shorter prefix plus one token. So one token for each prefix, its last one,
stores the encodings of all prefixes: appending continues the table, an edit recomputes it from
the edit on, and the encoding is read off backwards. A token may follow another exactly if BPE
encodes the two tokens' bytes as these two tokens.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Substrings, only, slices
from .vocabulary import MULTI, PATTERN, ranks


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Textbook BPE: join the neighbours whose union has the lowest rank until none has one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [rank[p] for p in parts]


class PrefixBPE:
    """Encodes pieces of text (matches of the pattern that splits texts before merging)."""

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        self.token = {i: t for t, i in rank.items()}
        self.longest = max(map(len, rank))
        self.n = max(rank.values()) + 1
        self.pairs: dict[int, bool] = {}
        # A hash table of tokens for the vectorised lookup: two choices of slot, tokens of equal slots chained.
        data = np.frombuffer(b"".join(rank), np.uint8)
        ends = np.cumsum([len(t) for t in rank])
        starts = np.concatenate([[0], ends[:-1]])
        self.hashes = Substrings(data)(starts, ends)
        order = np.argsort(self.hashes)
        self.hashes, self.ids = self.hashes[order], np.fromiter(rank.values(), np.int64)[order]
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        slots = (self.hashes >> self.shift).astype(np.int64)
        self.chain = int(np.bincount(slots).max())
        self.sizes = np.bincount([len(t) for t in rank], minlength=self.longest + 1) > 0

    def follows(self, a: int, b: int) -> bool:
        """May token ``b`` follow token ``a``?"""
        key = a * self.n + b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = merge(self.token[a] + self.token[b], self.rank) == [a, b]
        return known

    def extend(self, last: list[int], piece: bytes) -> list[int]:
        """``last`` holds the last tokens of the first prefixes of ``piece``; add the others'."""
        rank, tails = self.rank, self.tails
        for end in range(len(last) + 1, len(piece) + 1):
            fits, n = [], 1  # tokens that end here, shortest first
            while n <= end and (tail := piece[end - n : end]) in tails:
                if (t := rank.get(tail)) is not None:
                    fits.append((n, t))
                n += 1
            last.append(next(t for n, t in reversed(fits) if n == end or self.follows(last[end - n - 1], t)))
        return last

    @functools.cached_property
    def tails(self) -> set[bytes]:
        """All ends of all tokens: a string that is none is not the end of a longer token either."""
        return {t[i:] for t in self.rank for i in range(len(t))}

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return out[::-1]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the tokens with these hashes, -1 where there is none."""
        at = self.first[(hashes >> self.shift).astype(np.int64)].astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        for k in range(self.chain):
            i = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[i] == hashes
            out[hit] = self.ids[i[hit]]
        return out

    def follow_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, where = np.unique(a * self.n + b, return_inverse=True)
        return np.fromiter((self.follows(int(k) // self.n, int(k) % self.n) for k in keys), bool, len(keys))[where]

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """Encode many pieces at once: the prefixes of one length of all pieces in each step."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = [i for i, n in enumerate(size) if n > 64]
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        hashes, last = Substrings(data), np.full(len(data), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[len(long) :]  # pieces of over 64 bytes come first
        sizes = -size[order]
        for end in range(1, int(-sizes[0] if len(sizes) else 0) + 1):
            w = order[: np.searchsorted(sizes, -end, "right")]
            s = start[w]
            for n in range(min(end, self.longest), 0, -1):
                if not len(s):
                    break
                if not self.sizes[n]:
                    continue
                t = self.find(hashes(s + end - n, s + end))
                ok = t >= 0
                if n < end and ok.any():
                    i = np.flatnonzero(ok)
                    ok[i] = self.follow_all(last[s[i] + end - n - 1], t[i])
                last[s[ok] + end - 1] = t[ok]
                s = s[~ok]
        table = last.tolist()
        out = [self.read(table[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)] if not long else None
        if out is None:
            skip = set(long)
            out = [self.read(self.extend([], words[i])) if i in skip else self.read(table[a : a + n]) for i, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True))]
        return out


class Editor:
    """The token table of one piece of bytes, kept up to date through appends and edits."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece = bpe, piece
        self.last = bpe.extend([], piece)

    def append(self, more: bytes) -> list[int]:
        self.piece += more
        self.bpe.extend(self.last, self.piece)
        return self.ids()

    def edit(self, start: int, end: int, new: bytes) -> list[int]:
        """Replace ``piece[start:end]``; prefixes that end before the edit keep their tokens."""
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = self.bpe.extend(self.last[:start], self.piece)
        return self.ids()

    def ids(self) -> list[int]:
        return self.bpe.read(self.last)


@functools.lru_cache(2)
def codec(path: str = MULTI) -> PrefixBPE:
    return PrefixBPE(ranks(path))


#: Bytes of pieces of text, and what belongs to them, that a Python worker remembers; it forgets all beyond.
REMEMBERED = 128 << 20
#: What an entry takes besides its contents.
ENTRY = 400


class TextCodec:
    """Encodes and decodes whole texts; remembers pieces that it has met."""

    def __init__(self, path: str = MULTI):
        self.bpe = codec(path)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> None:
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = [p for p in pieces if p not in self.known]
        words = [p.encode() for p in new]
        token = self.bpe.token
        for p, ids in zip(new, self.bpe.encode_many(words), strict=True):
            text = ",".join(map(str, ids))
            whole = b"".join([token[i] for i in ids])
            self.known[p] = (text, len(ids), whole)
            self.held += ENTRY + len(text) + 2 * len(whole)

    def __call__(self, texts: list[str]) -> list[tuple[list[str], list[str]]]:
        """For each text its pieces; all are remembered afterwards."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        return split

    def encode(self, text: str) -> list[int]:
        (pieces,) = self([text])
        return [int(i) for p in pieces for i in self.known[p][0].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bpe.token[i] for i in ids])


#: Bytes of text that are encoded together.
TOGETHER = 1 << 20


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MULTI) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text. A null text is an
    empty one and has no tokens; rows are taken one by one, so ids may be null and repeat, and an
    empty table gives an empty result; other columns, whatever their names, are ignored. A text of
    any length is encoded whole, in time that grows with its length even without a break. One
    narrow pass without a shuffle."""

    def run(batches):
        code = TextCodec(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n_tokens, ids_hex, bytes_hex = [], [], []
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j]) <= TOGETHER):
                    total += len(texts[j])
                    j += 1
                split = code(texts[i:j])
                known = code.known
                for pieces in split:
                    got = [known[p] for p in pieces]
                    ids = hashlib.sha256(",".join([g[0] for g in got]).encode())
                    n_tokens.append(sum([g[1] for g in got]))
                    ids_hex.append(ids.hexdigest())
                    bytes_hex.append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
                i = j
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[doc_id].dataType.simpleString()
    return only(df, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MULTI) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, with the rules of :func:`digests`."""

    def run(batches):
        code = TextCodec(path)
        for b in slices(batches):
            ids = [code.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return only(df, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str = MULTI) -> DataFrame:
    """``doc_id, bytes``: the bytes that the ids stand for; null ids give no bytes."""

    def run(batches):
        code = TextCodec(path)
        for b in batches:
            out = [code.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    kind = df.schema[doc_id].dataType.simpleString()
    return only(df, doc_id=doc_id, ids=ids).mapInArrow(run, f"doc_id {kind}, bytes binary")


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
