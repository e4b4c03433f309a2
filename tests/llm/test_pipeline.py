"""The pipeline's stages and run() against a plain version on a small fixture."""

import base64
import hashlib
import random

import corpus_pipeline
import pytest

from provisio.llm import quality

ITEM = "Which river rises in the high glacier valley and ends in the northern sea? It is the old grey river of stones."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, runs string"


def make_rows():
    rng = random.Random(8)
    good = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["".join(rng.choice("#%&*qxz09") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    sentence = lambda words, n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    texts = []
    for i in range(160):
        words = bad if i % 4 == 3 else good
        texts.append("\n".join(sentence(words, rng.randint(12, 30)) for _ in range(rng.randint(2, 5))))
    shared = "\n".join(sentence(good, 12) for _ in range(3))
    for i in (20, 40, 60):
        texts[i] += "\n" + shared  # a run of lines that repeats
    texts[81] = texts[80]
    texts[84] = texts[82].replace("\n", " ") + " zebra"  # near copy, other lines
    texts[90] = f"{texts[90]} {ITEM} {texts[90][:30]}"
    texts[92], texts[94] = None, ""
    texts[96] = " ".join(sentence(good, 20) for _ in range(900))
    labels = [(i, int(i % 4 != 3)) for i in range(160) if i % 3]
    return texts, labels


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    texts, labels = make_rows()
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, None) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[10]], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def plain_lines(docs):
    """docs: [(id, text)] in order of id; later copies of line runs of 100 characters go."""
    lines = {i: t.split("\n") for i, t in docs if t is not None}
    gone = {i: [False] * len(x) for i, x in lines.items()}
    for width in range(1, max(map(len, lines.values())) + 1):
        seen = set()
        for i, x in lines.items():
            for s in range(len(x) - width + 1):
                run = tuple(x[s : s + width])
                if run in seen and sum(map(len, run)) >= 100:
                    gone[i][s : s + width] = [True] * width
                seen.add(run)
    return [(i, t if t is None else "\n".join(y for y, g in zip(lines[i], gone[i], strict=True) if not g)) for i, t in docs if t is None or not all(gone[i])]


def plain_near(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, t) for i, t in docs if find(i) == i]


def stage(spark, sf, name, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert name == "byte_bpe" or out.dtypes == docs.dtypes
    return out


def pairs(df):
    return sorted({(r.doc_id, r.text) for r in df.collect()})


def test_run_equals_a_plain_version(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = quality.classify(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    left = sorted({(r.doc_id, r.text) for r in scored.where("predicted = 1").collect()})
    assert pairs(stage(spark, sf, "quality_classifier", docs)) == left
    junk = {i for i in range(160) if i % 4 == 3}
    assert not junk & {i for i, _ in left} and len(left) >= 115
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, None) for i, t in rows], SCHEMA)
    for name, plain in (("line_dedup", plain_lines), ("near_dedup", plain_near), ("decontamination", lambda docs: [(i, t) for i, t in docs if ITEM not in (t or "")])):
        got, left = pairs(stage(spark, sf, name, frame(left))), plain(left)
        assert got == sorted(left), name
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {i for i, _ in left} and {10, 92, 94, 96} <= set(got) and not {81, 84, 90} & set(got)
    for i, t in left:
        ids = codec.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_repeated_rows_stay_together(spark, sf):
    assert sum(r.doc_id == 10 for r in corpus_pipeline.run(spark, sf).collect()) == 2


def test_stages_on_an_empty_table(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, sf, name, none).count() == 0, name


def test_near_stage_loses_no_text_of_a_repeated_id(spark):
    a = "one text of some words that stands in two documents and more words beside"
    rows = [(1, a), (5, a), (5, "quite another text that stands nowhere else in the table at all"), (7, a), (7, a), (None, a)]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, a), *rows[1:3], (None, a)], key=repr)
