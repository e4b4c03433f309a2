"""Terms in paragraphs, by automata, against a plain search."""

import random

from provisio.operators import semantics


def test_uses_term_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(semantics, "PARAGRAPH_BLOCK", 7)
    monkeypatch.setattr(semantics, "TERM_BLOCK", 5)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abÉé ") for _ in range(rng.randint(1, 4)))
    chunks, terms, want = [], [], set()
    for d in (1, 2, 3):
        own = [(d, f"t{d}:{k}", t) for k, t in enumerate({word().lower() for _ in range(30)})] + [(d, f"t{d}:copy", "ab")] if d < 3 else []
        texts = [(d, k, f"p{d}:{k}", None if k == 3 else "" if k == 4 else "".join(word() for _ in range(rng.randint(1, 12)))) for k in range(40)]
        chunks += [(d, k, i, "paragraph", t) for d, k, i, t in texts] + [(d, 99, f"a{d}", "article", "ab")]
        terms += own
        want |= {(d, k, i, name) for d, k, i, t in texts for _, name, term in own if t is not None and term in t.lower()}
    got = semantics.uses_term(spark.createDataFrame(chunks, "doc_id long, ord int, id string, chunk_type string, text string"), spark.createDataFrame(terms, "doc_id long, term_id string, normalized_term string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want


def test_many_terms_take_linear_work(spark):
    n = 5_000
    chunks = spark.range(n).selectExpr("1L AS doc_id", "CAST(id AS INT) AS ord", "concat('p', id) AS id", "'paragraph' AS chunk_type", "concat('see term number ', id, '; and nothing else') AS text")
    terms = spark.range(n).selectExpr("1L AS doc_id", "concat('t', id) AS term_id", "concat('number ', id, ';') AS normalized_term")
    got = semantics.uses_term(chunks, terms).collect()  # 25 million pairs
    assert len(got) == n and all(r.paragraph_id[1:] == r.term_id[1:] for r in got)
