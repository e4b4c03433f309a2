"""The Merkle tree of documents kept by changed paths, and differences found from the top."""

import random

from provisio.operators import changes


def frames(spark, world):
    docs = spark.createDataFrame([(d,) for d in world], "id string")
    articles = spark.createDataFrame([(a, d, f"t{a}") for d, own in world.items() for a in own], "id string, parent_id string, title string")
    paragraphs = spark.createDataFrame([(p, a, t) for own in world.values() for a, ps in own.items() for p, t in ps.items()], "id string, parent_id string, text string")
    return docs, articles, paragraphs


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_update_equals_a_new_tree(spark):
    rng = random.Random(2)
    world = {f"d{d}": {f"d{d}a{a}": {f"d{d}a{a}p{p}": f"text {rng.random()}" for p in range(rng.randint(0, 4))} for a in range(3)} for d in range(12)}
    world["empty"] = {}
    old = changes.merkle_tree(*frames(spark, world))
    changed = [("d1a0new", "d1a0", "fresh"), ("d1a1p9", "d1a1", "other")]
    world["d1"]["d1a0"]["d1a0new"], world["d1"]["d1a1"]["d1a1p9"] = "fresh", "other"
    gone = next(p for p in world["d4"]["d4a2"] or world["d4"]["d4a1"])
    art = gone.rsplit("p", 1)[0]
    del world["d4"][art][gone]
    changed.append((gone, art, None))
    update = changes.merkle_update(old, spark.createDataFrame(changed, "id string, parent_id string, text string"))
    assert {(r.level, r.id) for r in update.collect()} == {("paragraph", "d1a0new"), ("paragraph", "d1a1p9"), ("paragraph", gone), ("article", "d1a0"), ("article", "d1a1"), ("article", art), ("document", "d1"), ("document", "d4")}
    new = changes.merkle_merged(old, update)
    assert rows(new) == rows(changes.merkle_tree(*frames(spark, world)))
    assert rows(changes.merkle_differences(old, new)) == {
        ("document", "d1", "changed"), ("document", "d4", "changed"), ("article", "d1a0", "changed"), ("article", "d1a1", "changed"), ("article", art, "changed"),
        ("paragraph", "d1a0new", "added"), ("paragraph", "d1a1p9", "added"), ("paragraph", gone, "removed"),
    }
    assert not rows(changes.merkle_differences(new, new))
