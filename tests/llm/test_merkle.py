"""The Merkle manifest against its DuckDB form and a plain reading of the rules, over sources of many sizes."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from compare import oracle_rows, spark_rows

from provisio.llm import merkle

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    """Root, and the siblings left and right of each node, level by level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def plain(rows):
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        made[s] = (own, *tree([leaf(r, r["text"]) for r in own]))
    root, above = tree([made[s][1] for s in order])
    out = []
    for s, upper in zip(order, above, strict=True):
        own, sub, paths = made[s]
        for r, path in zip(own, paths, strict=True):
            path = path + upper
            first = leaf(r, r["text"])
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in path:
                node = h(left, node, right)
            out.append((r["doc_id"], first, sub, root, h(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def made(n_sources, sizes, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for s in range(n_sources):
        for _ in range(rng.choice(sizes)):
            k += 1
            text = rng.choice([None, "", "line\nline", "é日\n", "same", "x" * rng.randint(0, 2000) + "\n" * rng.randint(0, 3)])
            rows.append({"doc_id": k, "text": text, "lang": rng.choice([None, "de"]), "source": f"s{s}" if s else None, "n_chars": rng.choice([None, 3]), "leaf": "clash", "pos": 1, "grp": None})
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, grp string"


@pytest.mark.parametrize("n_sources, sizes", [(1, [1]), (1, [100]), (2, [1]), (3, [82, 81, 80]), (90, [1, 2, 3, 4]), (12, [1, 9, 28, 250]), (1, [700])])
def test_against_plain_reading(spark, n_sources, sizes):
    rows = made(n_sources, sizes)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_odd_rows(spark):
    base = {"lang": None, "n_chars": None, "leaf": "", "pos": 0, "grp": ""}
    rows = [{"doc_id": d, "source": s, "text": t, **base} for d, s, t in [(None, "a", "x\ny"), (None, None, None), (1, "a", "q\nq"), (1, "a", "q\nq"), (1, "a", "p"), (-5, "a", "n\n"), (2, "", "e"), (2, "é", "u\n"), (2, "z", "u")]]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain(rows)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark):
    got = spark_rows(merkle.op13_merkle_manifest(spark, SF))
    assert got == oracle_rows(merkle.ORACLE, SF)
    rows = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").to_arrow_table().to_pylist()
    assert [tuple(r) for r in got[1]] == sorted((tuple(dict(zip(("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), r, strict=True))[c] for c in got[0]) for r in plain(rows)), key=repr)
