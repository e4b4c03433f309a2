"""The suffix tree against a brute-force version, and its two ways of looking values up."""

import collections
import math
import time

import numpy as np
import pyarrow as pa
import pytest

from provisio.llm import suffixtree

TEXTS = [None, "", "abcdefgh " * 3, "q", "Caf\u00e9 \u65e5\u672c\u8a9e " * 20] + [f"the cat {i} sat on the mat and said hello" for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, gram string, score double").repartition(3)


def brute_force():
    """Scores by the definition: contexts in dictionaries, one symbol at a time."""
    depth, end = suffixtree.DEPTH, bytes([suffixtree.END])
    symbols = [b" ".join((t or "").lower().encode().split()) + end for t in TEXTS]
    train = [s for i, s in enumerate(symbols) if suffixtree_fold(i) != 2 for _ in range(2 if i == 7 else 1)]
    after = collections.defaultdict(collections.Counter)
    for s in train:
        for k in range(len(s)):
            before = end * depth + s[:k]
            for d in range(depth + 1):
                after[before[len(before) - d :]][s[k]] += 1
    tests = {c: sum(n * math.log(n / x.total() / (after[c[1:]][b] / after[c[1:]].total())) for b, n in x.items()) for c, x in after.items() if c and x.total() >= suffixtree.LEAST}
    kept = {c[k:] for c, gain in tests.items() if gain > suffixtree.DIVERGENCE for k in range(len(c))}

    def share(context, b):
        if not context:
            return (after[b""][b] + 1) / (after[b""].total() + 256)
        q = share(context[1:], b)
        x = after[context] if context in kept else None
        return q if x is None else (x[b] + suffixtree.PRIOR * len(x) * q) / (x.total() + suffixtree.PRIOR * len(x))

    out = []
    for s in symbols:
        total = 0.0
        for k in range(len(s)):
            before = end * depth + s[:k]
            total += math.log10(share(before[-depth:], s[k]))
        out.append(total)
    return out, len(kept)


def suffixtree_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 7


@pytest.mark.parametrize("most", [suffixtree.MODEL_GRAMS, 0])
def test_scores_equal_brute_force(docs, monkeypatch, most):
    """By broadcast and by joins; texts of the held-out fold, bytes over 127 and repeated rows among them."""
    monkeypatch.setattr(suffixtree, "MODEL_GRAMS", most)
    monkeypatch.setattr(suffixtree, "LONG_BYTES", 100)
    want, contexts = brute_force()
    rows = suffixtree.score(docs).collect()
    assert contexts > 30 and len(rows) == len(TEXTS) + 1
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-5 * max(1, -want[r.doc_id]), r.doc_id


def test_sums_to_one(docs):
    tree = suffixtree.collected(*suffixtree.grow(suffixtree.staged(suffixtree.gram_counts(docs.where("text IS NOT NULL")), "grams")))
    contexts = [int.from_bytes(c, "big") for c in (b"the ca", b"at on ", b"zzzzzz", b"\n\n\n\n\n\n", b"q\nt\xc3\xa9x")]
    for c in contexts:
        assert abs((10 ** suffixtree.log10_values(tree, np.arange(256) + (c << 8))).sum() - 1) < 1e-4


def test_symbols():
    symbols, new = suffixtree._symbols(pa.array([" A  b\t", None, "\u00c9"]))
    assert bytes(symbols) == b"a b\n\n\xc3\x89\n" and new.tolist() == [0, 4, 5, 8]


def test_rare_contexts_outlive_a_larger_corpus(spark):
    """A context found 30 times among seven million other symbols is kept, although its suffix is common and goes on in another way."""
    rows = spark.range(30).select(suffixtree.F.lit("qabz").alias("text")).union(spark.range(4000).select(suffixtree.F.expr("repeat('ab ', 600)").alias("text")))
    _, contexts = suffixtree.retained(suffixtree.staged(suffixtree.gram_counts(rows), "grams"))
    assert int.from_bytes(b"qab", "big") in {r.context for r in contexts[3].collect()}


def batches_of(chunks, texts, rows):
    return pa.Table.from_pydict({"_chunk": pa.array(chunks, pa.int64()), "text": pa.array(texts, pa.string())}).to_batches(rows)


def test_counts_of_parts_are_merged(monkeypatch):
    """Chunks that end within a batch, counts merged several times, none for no rows."""
    monkeypatch.setattr(suffixtree, "COUNT_GRAMS", 30)
    monkeypatch.setattr(suffixtree, "MERGE_GRAMS", 40)
    chunks = [0] * 20 + [3] * 13 + [-7] * (len(TEXTS) - 33)
    want = collections.Counter()
    for c, t in zip(chunks, TEXTS, strict=True):
        s = bytes([suffixtree.END]) * suffixtree.DEPTH + b" ".join((t or "").lower().encode().split()) + bytes([suffixtree.END])
        for k in range(suffixtree.DEPTH, len(s)):
            want[c, int.from_bytes(s[k - suffixtree.DEPTH : k + 1], "big")] += 1
    got = [r for b in suffixtree._seen(iter(batches_of(chunks, TEXTS, 6))) for r in b.to_pylist()]
    assert {(r["_chunk"], r["gram"]): r["n"] for r in got} == want and len(got) == len(want)
    assert not list(suffixtree._seen(iter([])))


def test_counting_costs_a_few_sorts():
    """Of two million varied symbols; about 5 sorts; hashing them slice by slice took as long as 31."""
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 20_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 400)) for _ in range(900)]
    batches = batches_of([0] * len(texts), texts, 300)
    symbols, new = suffixtree._symbols(pa.array(texts))
    grams = suffixtree._grams(symbols, new, suffixtree.DEPTH)

    def least(run):
        seconds = []
        for _ in range(3):
            began = time.process_time()
            run()
            seconds.append(time.process_time() - began)
        return min(seconds)

    assert least(lambda: sum(b.num_rows for b in suffixtree._seen(iter(batches)))) < 15 * least(lambda: np.sort(grams))


def test_places():
    rng = np.random.default_rng(1)
    inverse = pow(suffixtree.BASE, -1, 1 << 64)
    last = np.array([(2**64 - 1) * inverse % 2**64], np.uint64).view(np.int64)  # its product is the end mark
    close = (np.arange(64, dtype=np.uint64) * np.uint64(inverse)).view(np.int64)  # products 0 to 63 share leading bits
    for keys in (np.zeros(0, np.int64), np.array([5]), last, np.r_[last, 0, 1, -1], close, np.arange(1000) << 48, np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))):
        keys = keys[suffixtree.Places.order(keys)]
        sought = np.r_[keys, keys + 1, keys - 1, rng.integers(-(2**63), 2**63 - 1, 1000), last, 0]
        at, there = suffixtree.Places(keys).find(sought)
        assert (there == np.isin(sought, keys)).all() and (keys[at[there]] == sought[there]).all()
