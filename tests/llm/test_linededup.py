"""Line dedup against brute force over windows of every width."""

import random

from provisio.llm import linededup


def test_every_width(spark):
    rng = random.Random(7)
    unique = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    three, seven, short_ends = [unique(40) for _ in range(3)], [unique(24) for _ in range(7)], ["x", unique(150), "y", "", "z"]
    many = [unique(3) for _ in range(60)]
    pool = [unique(n) for n in (0, 1, 9, 20, 30, 45, 60)]
    texts = []
    for i in range(24):
        own = [unique(rng.randint(5, 50)) for _ in range(3)]
        texts.append("\n".join([own[0], *(three, seven, short_ends, many)[i % 4], own[1], *rng.choices(pool, k=rng.randint(0, 12)), own[2]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lines = [t.split("\n") for t in texts]
    gone = [[False] * len(x) for x in lines]
    for width in range(1, max(map(len, lines)) + 1):
        seen = set()
        for i, x in enumerate(lines):
            for s in range(len(x) - width + 1):
                run = tuple(x[s : s + width])
                if run in seen and sum(map(len, run)) >= linededup.LEAST_CHARS:
                    gone[i][s : s + width] = [True] * width
                seen.add(run)
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    for i, x in enumerate(lines):
        assert got[i].n_removed == sum(gone[i]) and got[i].text == "\n".join(t for t, g in zip(x, gone[i], strict=True) if not g), i
    assert all(g[1:4] == [True] * 3 for g in gone[4::4]) and all(g[1:8] == [True] * 7 for g in gone[5::4])
