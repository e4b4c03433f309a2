"""SimHash classes against brute force over all pairs, fingerprints against the library's hash."""

import random
import re

import numpy as np
import pytest
import xxhash

from provisio.llm import simhash

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashed = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in hashed) > len(hashed))


def classes(fps):
    """Least place reachable, by all pairs."""
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 2) for f in fps]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def check(spark, rows, extra=""):
    got = {}
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int, root string")).collect():
        assert got.setdefault(r.doc_id, r) == r
    fps = [fingerprint(r[1]) for r in rows]
    assert {k: r.fingerprint for k, r in got.items()} == {r[0]: f"{f:016x}" for r, f in zip(rows, fps, strict=True)}
    assert {k: r.component_id for k, r in got.items()} == {r[0]: rows[c][0] for r, c in zip(rows, classes(fps), strict=True)}


def test_hash_of_all_lengths():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4900, 3000)
    end = start + rng.integers(0, 100, 3000)
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end, strict=True)]
    assert simhash.hashes(data, start, end).tolist() == want


def test_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeÄé日") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    texts = [None, "", " \n\x0b", "One", "one", "two WORDS", "two words", "a b c", "x" * 70_000 + " y z w", "  a", "the same " * 80_000]
    for _ in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        texts += [" ".join(body), "\t ".join(body), " ".join(body).title()]
        for _ in range(3):
            body[rng.randrange(len(body))] = rng.choice(words)
            texts.append(" ".join(body))
    check(spark, [(i, t, i, "x") for i, t in enumerate(texts)])


def test_clouds_are_joined_across_tiles(spark, monkeypatch):
    """Fingerprints a few bits apart, in tiles of few members, at each number of parts."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(9)
    fps = {0, 2**64 - 1, 1, 2**63}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            f ^= 1 << rng.randrange(64) if rng.random() < 0.4 else (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.add(f)
    fps = sorted(fps)
    want = classes(fps)
    groups = {fps[i]: fps[c] for i, c in enumerate(want)}
    for parts in (4, 16):
        df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
        root = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df, parts)).collect()}
        by = {}
        for f in fps:
            by.setdefault(root.get(f, ("alone", f)), set()).add(groups[f])
        assert all(len(g) == 1 for g in by.values()) and len(by) == len(set(groups.values()))


def test_dense_tile_gives_few_links():
    left = np.arange(256, dtype=np.uint64)
    a, b = simhash.compare(left, left.copy(), 8)
    assert len(a) <= 512
    assert len({tuple(x) for x in simhash.offsets(4)}) == len(simhash.offsets(4)) == 21


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "e f g"), (None, "lonely words here now"), (9, None), (4, "")]
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 7
    by = {(d, f): c for d, f, c in got}
    assert by[None, f"{fingerprint('a b c d'):016x}"] == 7 and by[None, f"{fingerprint(rows[4][1]):016x}"] is None
    assert by[9, "0" * 16] == 4 and by[4, "0" * 16] == 4
    empty = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [fingerprint(t) for _, t in rows]
    want = {(i, f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, classes(fps), strict=True)}
    assert {tuple(r) for r in simhash.op11_simhash_near_dedup(spark, sf).collect()} == want
