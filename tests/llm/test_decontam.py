"""Benchmark items that were altered, have short answers or are short themselves."""

import random

import pyarrow as pa

from provisio.llm import decontam


def test_altered_and_short_items(spark):
    rows = [(1, "which planet was seen crossing beyond distant stars? it appeared slowly during late autumn evenings"), (2, "Which metal melts slightly above room temperature in summer? Gallium"), (3, "Blue whale."), (4, "")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = [
        rows[0][1].replace("crossing", "passing"),
        "Quiz. Which metal melts slightly above room temperature in summer? Answer: gallium. Next",
        "a blue, WHALE swims",
        "a blue and a whale",
        "which metal melts slightly? none",
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()} == {(0, 1), (1, 2), (2, 3)}
    assert {r.doc_id for r in decontam.decontaminate(docs, items).collect()} == {3, 4, 5}


def test_long_items_do_not_stretch_the_passages_of_short_ones(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long_item, short_items = " ".join(rng.choices(words, k=3000)), [" ".join(rng.choices(words, k=12)) for _ in range(20)]
    index = decontam.build_index(list(range(21)), [long_item, *short_items], 21, 150.0)
    assert sorted(i.passage for i in index) == [64, 3000]
    text = " ".join(rng.choices(words, k=500)) + " " + short_items[3] + " " + long_item
    found = {r[1] for r in decontam.find(index, pa.array([text, short_items[7], "nothing of it"]))}
    assert found == {0, 4, 8}


def test_blocks_of_common_terms_alone_are_bounded():
    """Items of nothing but words that all items have."""
    rng = random.Random(6)
    items = [" ".join(rng.sample([f"c{i}" for i in range(12)], 10)) for _ in range(30)]
    index = decontam.build_index(list(range(30)), items, 30, 10.0)
    found = {(r[0], r[1]) for r in decontam.find(index, pa.array([items[4], "other words only here and there"]))}
    assert (0, 4) in found and not any(d == 1 for d, _ in found)
