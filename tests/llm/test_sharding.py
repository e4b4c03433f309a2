"""Balanced label propagation: links kept together, and quotas."""

import collections
import random

from provisio.llm import sharding


def topics(n_topics, size, seed=0):
    """Documents that share lines with those of their topic, each one with a line of its own and one that a third of all have."""
    rng = random.Random(seed)
    rows = []
    for t in range(n_topics):
        lines = [f"line {k} of topic {t} " + "x" * 40 for k in range(4)]
        for _ in range(size):
            own = [*rng.sample(lines, 2), f"own line {len(rows)} " + "y" * 40]
            if rng.random() < 0.33:
                own.append("the same line in a third of all documents, of some length")
            rows.append((len(rows), "\n".join(own), t))
    return rows


def cut(spark, rows):
    got = {r.doc_id: r for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, slot int")).collect()}
    counts = collections.Counter(r.shard for r in got.values())
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    by_topic = collections.defaultdict(list)
    for i, _, t in rows:
        by_topic[t].append(got[i].shard)
    pairs = [(a, b) for x in by_topic.values() for k, a in enumerate(x) for b in x[:k]]
    return sum(a != b for a, b in pairs) / len(pairs)


def test_all_documents_linked(spark):
    """At random, 15 pairs of 16 would be cut."""
    assert cut(spark, topics(160, 10)) < 0.1


def test_departures_free_room():
    load = {0: 100, 1: 100, 2: 100}
    shares = sharding.allowed_shares(load, [(3, 0, 1, 40), (2, 1, 2, 40), (1, 2, 0, 40)], 101.0)
    now = dict(load)
    for s, t, b, share in shares:
        n = round(share * 40)
        now[s], now[t] = now[s] - n, now[t] + n
    assert len(shares) == 3 and min(x[3] for x in shares) > 0.9 and max(now.values()) <= 102


def test_quota_holds():
    assert sharding.allowed_shares({0: 50, 1: 100}, [(1, 0, 1, 50)], 100.0) == []


def groups_cut(spark, rows):
    """How many groups of equal texts stand on several shards, of those under PART of a shard; counts must be even."""
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    counts, texts, shards = collections.Counter(r.shard for r in got), dict(rows), collections.defaultdict(set)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    assert {(r.shard, r.slot) for r in got} == {(s, k) for s, n in counts.items() for k in range(n)}
    sizes = collections.Counter(texts.values())
    for r in got:
        shards[texts[r.doc_id]].add(r.shard)
    return sum(len(s) > 1 for t, s in shards.items() if sizes[t] < sharding.PART * len(rows) / 16), len(shards)


def test_equal_texts_stay_together(spark):
    """All documents linked, a third of them in groups of two or three."""
    texts = [t for _, t, _ in topics(100, 10)]
    texts += texts[:300] + texts[:150]
    assert groups_cut(spark, list(enumerate(texts))) == (0, 1000)


def test_groups_beyond_the_quota_move_whole(spark):
    """A third of all rows have one text, and most others are groups of up to four: shards with a part of the large group have too many groups."""
    texts = ["one text " * 9] * 1000 + [f"text {k // 4} of four" for k in range(1400)] + [f"text {k // 2} of two" for k in range(300)] + [f"single {k}" for k in range(300)]
    split, groups = groups_cut(spark, list(enumerate(texts)))
    assert split == 0 and groups == 1 + 350 + 150 + 300
