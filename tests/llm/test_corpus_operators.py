"""The corpus operators against brute force on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest

from provisio.llm import bpe, decontam, html, linededup, neardup, quality, rules, sharding, substrings, suffixtree

SPLIT = re.compile("[\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text, fold=False):
    t = text or ""
    return [w for w in SPLIT.split(t.translate(LOWER) if fold else t) if w]


def make_texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(30) for _ in range(3)]
    texts = [None, "", " \n\t", "One", "One", "日本語 🎉 text"]
    for i in range(60):
        body = [line(rng.randint(3, 25)).capitalize() for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), shared[i % 2])
        texts.append("\n".join(body))
    texts += [texts[10], texts[10], texts[11] + " x", texts[12].replace(" ", " y ", 1), "\n".join([shared[2]] * 5), "a" * 400, "ab ab ab ab ab ab ab ab ab ab ab ab"]
    texts.append("\n".join(line(20) for _ in range(400)))
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "src", i % 2, "x", 7) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, kept string, score int")
    return df.union(df.where("doc_id = 20"))  # one row stands twice


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r  # repeated rows agree
    return out


def test_near_duplicates(docs):
    got = by_id(neardup.near_duplicates(docs))
    sets = {}
    for i, t in enumerate(TEXTS):
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = dict(zip(sets, sets, strict=True))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_partners_are_bounded_not_lost(spark):
    """Variants with changes of their own make no pairs; a pair that can be similar stays."""
    none = [0] * (neardup.PARITY_BITS // 64)
    rows = [("k", i, i, 100, 85, none) for i in range(50)] + [("k", 100, 100, 100, 98, none), ("k", 101, 101, 90, 90, none), ("k", 102, 102, 92, 88, none)]
    pairs = {tuple(sorted(r)) for r in neardup._possible(spark.createDataFrame(rows, "key string, doc_id long, root long, n long, r long, parities array<long>"), 80).collect()}
    want = set()
    for _, a, _, na, ra, _ in rows:
        for _, b, _, nb, rb, _ in rows:
            if a < b and 180 * min(ra, rb) >= 80 * (na + nb):
                want.add((a, b))
    assert want <= pairs and len(pairs) <= 2 * len(want) + 60


def test_parities_never_rule_out_a_similar_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64) * np.uint64(2)
        x, y = (np.unique(np.r_[base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, 10, dtype=np.uint64)]) for _ in range(2))
        p, q = (neardup._parities(v, np.array([len(v)])) for v in (x, y))
        apart = sum(int(a ^ b).bit_count() if a ^ b >= 0 else int((a ^ b) + (1 << 64)).bit_count() for a, b in zip(p.tolist(), q.tolist(), strict=True))
        assert len(p) == neardup.PARITY_BITS // 64 and apart <= len(np.setxor1d(x, y)) and apart >= 0.5 * min(len(np.setxor1d(x, y)), 200)


def test_line_dedup(docs):
    got = by_id(linededup.dedup_lines(docs))
    lines = {i: t.split("\n") for i, t in enumerate(TEXTS) if t is not None}
    gone = {i: [False] * len(x) for i, x in lines.items()}
    width = 1
    while width <= max(map(len, lines.values())):
        seen = set()
        for i, x in lines.items():
            for s in range(len(x) - width + 1):
                run = tuple(x[s : s + width])
                if run in seen and sum(map(len, run)) >= linededup.LEAST_CHARS:
                    gone[i][s : s + width] = [True] * width
                seen.add(run)
        width *= 2
    assert got[0].text is None and got[0].n_lines == 0
    for i, x in lines.items():
        assert got[i].n_removed == sum(gone[i]) and got[i].text == "\n".join(t for t, g in zip(x, gone[i], strict=True) if not g), i


def test_substring_dedup(docs):
    got = by_id(substrings.remove_repeats(docs))
    seen = set()
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        cut = [False] * len(raw)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                cut[s : s + 100] = [True] * 100
            seen.add(w)
        runs = sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut))
        kept = bytes(b for b, c in zip(raw, cut, strict=True) if not c)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(raw), sum(cut), runs, kept), i


@pytest.mark.parametrize("most", [1, 2, 5])
def test_longer_anchors_agree(docs, monkeypatch, most):
    want = by_id(substrings.remove_repeats(docs, False))
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", most)
    assert by_id(substrings.remove_repeats(docs, False)) == want


def test_anchors_do_not_depend_on_the_block(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    off = np.array([0, 1200, 1200, 1250, 4100, 5000])
    each = lambda: {(g, s) for g, _, a, b in zip(*map(np.ndarray.tolist, substrings.anchors(data, off)), strict=True) for s in range(a, b + 1)}
    want = each()
    monkeypatch.setattr(substrings, "PLACE_BITS", 10)
    assert {s for _, s in each()} == {s for _, s in want} and len(each() & want) > 0.9 * len(want)
    monkeypatch.setattr(substrings, "PLACE_BITS", 12)
    assert len(each() ^ want) < 0.01 * len(want)


def test_merged_transforms():
    import numpy as np

    rng = random.Random(1)
    data = "".join(rng.choice("ab") for _ in range(3000)).encode() + b"q" * 300
    sizes = np.array([1000, 1300, 1000])
    s, a, b = substrings.later_windows(sizes, np.frombuffer(data, np.uint8), np.array([0, 1 << 40, 2 << 40]))
    assert list(zip(s, a, b, strict=True)) == [(2, 701, 1000)]


def test_rules(docs, labels):
    got = by_id(rules.apply_rules(docs, labels))
    for i, t in enumerate(TEXTS):
        w = words(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, i


def test_certified_cutoffs(spark):
    from pyspark.sql import functions as F

    rows = [(k, n) for n in (0, 50, 150, 700, 5000) for k in (0, 1, 5, 60) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", rules._certified(F.col("k"), F.col("n"), F.lit(4.0)).alias("ok"))
    from math import comb

    for r in df.collect():
        tail = sum(comb(r.n, j) * rules.RISK**j * (1 - rules.RISK) ** (r.n - j) for j in range(min(r.k, 60) + 1))
        assert r.ok == (r.n > 0 and r.k < r.n * rules.RISK and tail <= 0.05 / 4), tuple(r)


def test_sharding(docs):
    rows = sharding.assign(docs).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    counts = [len(slots[s]) for s in range(16)]
    assert len(rows) == len(TEXTS) + 1 and max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode(docs, bpe.public_vocabulary()))
    for i, t in enumerate(TEXTS):
        ids = want.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and got[i].decoded == (t or "") and got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_decontamination(spark, docs):
    item = "What is the colour of the large house near the old river? It is painted in a deep shade of green today."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Yes no."), (1, item)], "item_id long, text string")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(900, f"Some words before. {item.upper()} and after"), (901, item[:45]), (902, " ".join(words(item)[::-1]))], "doc_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in decontam.matches(more, items).collect()} == {(900, 1)}
    assert {r.doc_id for r in decontam.decontaminate(more, items).collect()} == set(range(len(TEXTS))) | {901, 902}


def test_retrieval_equals_full_scoring():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    v = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(v, range(60, 0, -1), k=rng.randint(5, 20))) for _ in range(40)]
    index = decontam.build_index(list(range(40)), items, 40, 12.0)[0]
    texts = [" ".join(rng.choices(v, range(60, 0, -1), k=rng.randint(0, 300))) for _ in range(30)]
    h, row = decontam._words(pa.array(texts))
    got = set(zip(*(x.tolist() for x in decontam.retrieve(index, h, row, 30)[:3]), strict=True))
    share = {}
    n_blocks = len(index.rest)
    for t in range(len(index.terms)):
        for e in range(index.block_start[t], index.block_start[t + 1]):
            for q in range(index.posting_start[e], index.posting_start[e + 1]):
                share[int(index.terms[t]), int(index.block_no[e]) * decontam.POSTING_BLOCK + int(index.posting_slot[q])] = index.posting_weight[q]
    assert n_blocks
    want = set()
    for d in range(30):
        own = h[row == d]
        for begin in range(0, max(1, -(-len(own) // index.passage) - 1) * index.passage, index.passage):
            terms = set(map(int, own[begin : begin + 2 * index.passage]))
            for i in range(40):
                if sum(share.get((t, i), 0) for t in terms) >= decontam.THRESHOLD:
                    want.add((d, begin, i))
    assert got == want and np.isfinite(index.own).all()


def test_scores(docs):
    got = by_id(suffixtree.score(docs))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    tokens = {i: [*words(t, True), "\n"] for i, t in enumerate(TEXTS)}
    counts = collections.Counter(w for i, x in tokens.items() if not held[i] for w in x * (2 if i == 20 else 1))
    n, v = sum(counts.values()), len(counts)
    import math

    for i, x in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(x), sum(counts[w] > 0 for w in x), n), i
        assert abs(got[i].base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) < 1e-6 and got[i].score < 0


def test_html(spark):
    ad = "<div class='promo-block'>Buy</div>"
    page = lambda i: f"<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class='page'><div><span>Same on all pages</span></div><p>Own {i}<p>A &amp; B&nbsp;{i}</div>{ad}<footer>f</footer>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(20, None, None), (21, "x", ""), (22, "u", "<article>One<br>two <b>three<p>four</article><aside>no</aside>"), (23, "u", "a < b & c")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Own 3\nA & B 3" and got[20].text == "" and got[21].text == "" and got[20].url is None
    assert got[22].text == "One two three\nfour" and got[23].text == "a < b & c" and all(r.n_chars == len(r.text) for r in got.values())


def test_quality(spark, docs, labels):
    got = by_id(quality.classify(docs.drop("score"), labels))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    none = quality.classify(docs.drop("score"), labels.where("quality = 5")).first()
    assert none.score == 0.5


def test_quality_does_not_follow_length():
    rng = random.Random(1)
    kind = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60))
    good, bad = [kind("aeionrst").encode() for _ in range(300)], [kind("xqz#%7").encode() for _ in range(300)]
    model = quality.CompressionModel(quality._dictionary(good[:150]), quality._dictionary(bad[:150]), [], [], [])
    x = quality._features(iter([good[200], b" ".join(good[200:290]), bad[200], b" ".join(bad[200:290])]), *quality._compressors(model))
    assert abs(x[0, 0] - x[1, 0]) < 0.1 and abs(x[2, 0] - x[3, 0]) < 0.1 and x[:2, 0].min() > 0 > x[2:, 0].max()


def test_quality_on_held_out_rows(spark):
    import numpy as np

    d = "/root/testdata/sf0.01"
    rows = quality.op5_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


@pytest.mark.parametrize("name", ["near", "lines", "bytes", "rules", "shards", "bpe", "scores", "quality", "leaks"])
def test_empty_tables(spark, docs, labels, name):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    f = {
        "near": lambda: neardup.near_duplicates(none), "lines": lambda: linededup.dedup_lines(none), "bytes": lambda: substrings.remove_repeats(none), "rules": lambda: rules.apply_rules(none, labels), "shards": lambda: sharding.assign(none),
        "bpe": lambda: bpe.encode(none, bpe.public_vocabulary()), "scores": lambda: suffixtree.score(none), "quality": lambda: quality.classify(none.drop("score"), labels.limit(0)), "leaks": lambda: decontam.matches(none, items),
    }[name]
    assert f().count() == 0
