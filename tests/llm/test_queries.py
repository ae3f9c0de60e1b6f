"""The registered queries and the pipeline's stages on small odd tables: nulls, empty and long texts,
ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from test_small import R, documents, plain_spans, prose

import __spark_entry__ as entry
import corpus_pipeline
from presswire.llm import licenses, quality

#: Names that operators use inside or return.
NAMES = ["th", "key", "n", "hash", "bucket", "spans", "score", "kept", "n_words", "shard", "th_", "TIE", "ta", "labels", "y"]


#: Words that the quality bands take for plain text.
WORDS = "the people of this town have always known that their river would return every spring and bring back what winter took from them while children waited near old bridges counting boats under grey morning light before school began".split()


def plain(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def rows_of_documents():
    rows = documents()
    rows += [(500 + i, plain(40, f"q{i}") + (" You vile grobnik." if i % 3 == 0 else "")) for i in range(120)]
    shared, near = plain(60, "shared"), plain(90, "near").split(" ")
    rows += [(800 + i, f"{plain(30, f'h{i}')}\n{shared}\n{plain(20, f't{i}')}") for i in range(6)]
    rows += [(820 + i, " ".join([*near[: 9 * i], "edit", *near[9 * i :]])) for i in range(6)]
    rows += [(830, plain(50, "same")), (831, plain(50, "same")), (831, plain(50, "same")), (832, plain(50, "same"))]
    rows += [(700, "All rights reserved. " + licenses.TEMPLATES["mit"][2]), (701, "GNU General Public License, version 2 " * 3), (702, "word " * 40_000), (703, "é" * 60_000), (704, "a.\n" * 5_000)]
    return rows


def vectors():
    r = random.Random(17)
    base = [[r.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.25) for x in base[i % 9]]) for i in range(120)]
    return rows + [(5, rows[5][1]), (5, rows[5][1]), (200, None), (201, []), (202, [0.0] * 12), (203, [float("inf")] * 12), (204, [None] * 12), (204, [None] * 12), (205, [1.0] * 5000), (206, [2.0] * 5000)]


TURNS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 1, "ann", "hi"), (1, 1, "bob b", "<|im_end|>"), (2, 0, None, "x"), (None, None, "ann", None), (None, 1, "bob", ""), (3, 0, "system", "alone"), (4, 0, "ann", "y" * 200_000)]


def write(spark, folder, empty=False):
    extra = ", ".join(f"`{n}` string" for n in NAMES)
    docs = [(i, t, ["en", "fr", None][k % 3], "s", k, *NAMES) for k, (i, t) in enumerate(rows_of_documents())]
    labels = [(i, 1, int("vile" in t)) for i, t in rows_of_documents() if i is not None and i >= 500 and t] + [(None, 1, 1), (501, None, None)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long, " + extra),
        "labels": (labels, "doc_id long, quality long, toxic long"),
        "embeddings": ([(i, v, 0, *NAMES) for i, v in vectors()], "vec_id long, embedding array<float>, label long, " + extra),
        "conversations": ([(*t, *NAMES) for t in TURNS], "conv_id long, turn long, role string, text string, " + extra),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([] if empty else rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), empty=True)


QUERIES = {k.split("_")[0]: f for k, f in entry.queries().items() if k.startswith("op")}


def run(spark, sf, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).collect()), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf, none, name):
    empty, full = QUERIES[name](spark, none), QUERIES[name](spark, sf)
    assert empty.count() == 0 and empty.dtypes == full.dtypes


def test_op1(spark, sf):
    got = run(spark, sf, "op1", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of_documents()]
    same([g[:3] for g in got], want)
    slots = defaultdict(list)
    for *_, law, shard, slot, grown in got:
        assert law == "rows" and 0 <= shard < 24 and grown is None
        slots[shard].append(slot)
    sizes = [len(slots[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2(spark, sf):
    docs = rows_of_documents()
    want = [w if i is not None and (t or "").split() else (w[0], w[0] if not (t or "").split() else w[1], *w[2:]) for w, (i, t) in zip(brute.jaccard(docs), docs, strict=True)]
    same(run(spark, sf, "op2", "doc_id", "class_id", "n_copies", "n_links"), want)


def test_op3(spark, sf):
    got = run(spark, sf, "op3", "doc_id", "held_out", "score", "predicted")
    docs = rows_of_documents()
    assert Counter(g[0] for g in got) == Counter(i for i, _ in docs)
    assert all(g[1] == (g[0] is not None and brute.held_out(g[0])) and 0 <= g[2] <= 1 and g[3] == int(g[2] >= 0.3) for g in got)
    toxic = {i for i, t in docs if "vile" in (t or "")}
    assert {g[0] for g in got if g[3]} == toxic and any(g[1] and g[3] for g in got)


def test_op4(spark, sf):
    got = run(spark, sf, "op4", "doc_id", "piece", "first_token", "n_tokens", "grp", "bin", "bin_offset", "capacity")
    enc, docs = brute.encoding(), rows_of_documents()
    want = Counter()
    for i, t in docs:
        n, first = 1 + len(enc.encode_ordinary(t or "")), 0
        while first < n:
            want[i, first // 8192, first, min(8192, n - first)] += 1
            first += 8192
    assert Counter(g[:4] for g in got) == want
    bins = defaultdict(list)
    for *_, n, grp, bin_, at, capacity in got:
        bins[grp, bin_].append((at, n, capacity))
    for parts in bins.values():
        used = 0
        for at, n, _ in sorted(parts):
            assert at == used
            used += n
        assert {c for *_, c in parts} == {min(c for c in (1024, 2048, 4096, 8192) if c >= used)}


def test_op5(spark, sf):
    same(run(spark, sf, "op5", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.repeated(rows_of_documents()))


def test_op6(spark, sf):
    got = Counter(run(spark, sf, "op6", "conv_id", "perspective", "turn", "speaker", "rendered", "loss", "loss_start", "loss_end"))
    want = Counter()
    for conv, me in {(c, s) for c, _, s, _ in TURNS if s != "system"}:
        for c, turn, speaker, text in TURNS:
            if c == conv:
                role = "system" if speaker == "system" else "assistant" if speaker == me else "user name=" + ("%unknown" if speaker is None else speaker.replace(" ", "%20"))
                head, body = f"<|im_start|>{role}\n", (text or "").replace("<|", "<\\|")
                whole = f"{head}{body}<|im_end|>\n"
                own = speaker == me
                want[c, me, turn, speaker, whole, own, len(head) if own else len(whole), len(whole)] += 1
    assert got == want


def test_op7(spark, sf):
    same(run(spark, sf, "op7", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), brute.bpe(rows_of_documents()))


def test_op8(spark, sf):
    import numpy as np

    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in vectors()]
    same(run(spark, sf, "op8", "vec_id", "n_links", "component_id", "kept"), brute.cosine(rows))


def test_op9(spark, sf):
    docs = rows_of_documents()
    same(run(spark, sf, "op9", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.base_quality(docs))
    enc, by = brute.encoding(), {}
    for (i, t), base in zip(docs, brute.base_quality(docs), strict=True):
        ids = enc.encode_ordinary(t or "")
        main, n, _, fallback, _ = quality.fertility(t or "", quality.tiktoken_encoding(), quality.known_characters())
        low, high, most, least = quality.BANDS[main]
        wide = 1 + (quality.SLACK / max(1, len(ids))) ** 2
        ok = n == len(ids) > 0 and low / wide <= len(t) / len(ids) <= high * wide and fallback <= most and brute.entropy(ids) >= least / wide
        by.setdefault(i, []).append(ok and not base[-1])
    got = defaultdict(list)
    for i, kept in run(spark, sf, "op9", "doc_id", "kept"):
        got[i].append(kept)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in by.items()}
    assert any(sum(got.values(), [])) and not all(sum(got.values(), []))


def test_op10(spark, sf):
    docs, want = rows_of_documents(), []
    for (_, t), base in zip(docs, brute.licenses(docs), strict=True):
        spans = [] if len(t or "") > 20_000 else plain_spans({**licenses.TEMPLATES, **{x: [p] for p, x in licenses.PHRASES.items()}}, t or "")
        labels = {x for x in base[5].split(",") if x} | {s[0] for s in spans}
        want.append((*base, ",".join(sorted(labels)), max([1.0 if base[2] else 0.0, *(s[3] for s in spans)])))
    got = run(spark, sf, "op10", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    same([(*g[:-1], round(g[-1], 9)) for g in got], [(*w[:-1], round(w[-1], 9)) for w in want])
    assert {"mit", "gpl-2.0", "gpl", "reserved"} <= {x for g in got for x in g[6].split(",")}


def stripped(docs):
    """Texts without the characters all of whose bytes repeat in 200-byte strings."""
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for (i, t), d in zip(docs, data, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                gone[p : p + 200] = b"\x01" * 200
        at, kept = 0, []
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, None if t is None else "".join(kept)))
    return out


def test_pipeline_stages(spark, sf):
    """Each stage against plain versions, on all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = [(r.doc_id, r.text) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "jaccard_join", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "packing":
            enc = brute.encoding()
            got = Counter()
            for r in rows:
                got[r.doc_id] += r.n_tokens
            want = Counter()
            for i, t in before:
                want[i] += 1 + len(enc.encode_ordinary(t or ""))
            assert got == want
            continue
        assert out.columns == docs.columns
        after = sorted(((r.doc_id, r.text) for r in rows), key=repr)
        if name == "toxicity":
            want = [(i, t) for i, t in before if "vile" not in (t or "")]
        elif name == "quality_rules":
            kept = {(r.doc_id, r.n_words, r.word_chars) for r in quality.measure(docs).where("kept").collect()}
            base = brute.base_quality(before)
            want = [x for x, b in zip(before, base, strict=True) if not b[-1] and b[:3] in kept]
            assert {i for i, _ in want} >= {i for i, _ in before if i is not None and (500 < i < 620 or i >= 800)}
        elif name == "jaccard_join":
            classes = brute.jaccard(before)
            first = {}
            for (i, t), c in zip(before, classes, strict=True):
                if c[1] == i:
                    key = (hashlib.md5(t.encode()).hexdigest(), t)
                    first.setdefault(i, set()).add(key)
            assert {i for i, _ in after} == {c[1] for c in classes} and len(after) == len(first)
            assert all(t in {x for _, x in first[i]} for i, t in after)
            want = after
        else:
            want = stripped(before)
            assert all(r.n_chars == len(r.text or "") for r in rows) and any(a != b for a, b in zip(sorted(want, key=repr), sorted(before, key=repr), strict=True))
        same(after, want)
        docs, before = spark.createDataFrame(rows, out.schema), after


def test_pipeline_of_empty_tables(spark, none):
    docs = spark.read.parquet(f"{none}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, none)
        assert out.count() == 0
        docs = docs if out.columns != docs.columns else out


def test_pipeline_run_leaves_one_table(spark, sf):
    """Tables of operators and earlier stages are gone when the pipeline has run; its result is there."""
    from presswire.llm import common

    out = corpus_pipeline.run(spark, sf)
    assert not common._tables and out.count() == len(set(out.select("doc_id", "piece").collect()))
    assert R is not None
