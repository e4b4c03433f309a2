"""Segmentation: known excerpts, edge cases, and generated texts against a sequential reading."""

import random
import re

from pyspark.sql import functions as F

from provisio.operators import segment, semantics

EXCERPT = """TITLE I
GENERAL PROVISIONS
Article 1
Subject matter
1. The purpose of this Regulation is to ensure the free movement of AI systems.
2. This Regulation lays down:
(a) rules;
(b) prohibitions.
Article 2
Scope
This Regulation applies to providers placing systems on the market.
Article 3
Definitions
For the purposes of this Regulation, the following definitions apply:
1. 'artificial intelligence system' means a system;
2. 'provider' means a person who develops an artificial intelligence tool."""


def chunked(spark, texts):
    docs = spark.createDataFrame([(i, f"D{i}", t) for i, t in enumerate(texts)], "doc_id long, short_name string, text string")
    return segment.chunks(docs)


def test_excerpt(spark):
    c = chunked(spark, [EXCERPT])
    rows = c.orderBy("ord").collect()
    assert [r.id for r in rows] == ["D0:preamble", "D0:art:1", "D0:art:1:para:1", "D0:art:1:para:2", "D0:art:2", "D0:art:3", "D0:art:3:para:1", "D0:art:3:para:2"]
    assert rows[0].text == "TITLE I\nGENERAL PROVISIONS" and rows[0].parent_id == "D0:root"
    assert rows[1].parent_id == "D0:art:1" and rows[1].text.startswith("1. The purpose") and "Subject matter" not in rows[1].text
    assert rows[4].text.startswith("Scope\n\nThis Regulation applies")
    assert rows[5].children_ids == ["D0:art:3:para:1", "D0:art:3:para:2"]
    terms = semantics.definitions(c)
    assert {r.term for r in terms.collect()} == {"artificial intelligence system", "provider"}
    assert {(r.paragraph_id, r.term_id) for r in semantics.uses_term(c, terms).collect()} == {("D0:art:3:para:1", "D0:term:artificial_intelligence_system"), ("D0:art:3:para:2", "D0:term:provider")}
    assert semantics.domains(c).first().domain == "Artificial Intelligence & Technology Regulation"
    assert semantics.obligations(c).count() == 0


def test_obligations(spark):
    text = """Article 1
Terms
The manufacturer and importer are jointly and severally liable for the damage caused.
Article 21
Exemption
Custom-made devices shall not bear the CE marking at all. They are accompanied by the statement referred to in Section 1 of Annex XIII."""
    c = chunked(spark, [text])
    rows = {r.obligation_id: r for r in semantics.obligations(c).collect()}
    assert rows["D0:art:1:obl:joint_liability"].role == "Manufacturer" and rows["D0:art:1:obl:joint_liability"].modality == "shall"
    assert rows["D0:art:21:obl:ce_marking_exemption"].role is None and "D0:art:21:obl:annex_xiii_statement" in rows
    assert {r.annex_id for r in semantics.annex_references(c).collect()} == {"D0:annex:XIII"}


def test_edges(spark):
    texts = ["", "Article 5\nStray\nArticle 1\nA", "As provided for in Article 6 and Article 16, it applies. Articles 7 do not. See Article 8 and 9.", "Article 1\nX\n42\n3.5 percent", "SECTION 1\nTitle\nANNEX iv\nT\nbody\nANNEX V", "Article 1\nA B"]
    rows = {}
    for r in chunked(spark, texts).orderBy("doc_id", "ord").collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert 0 not in rows
    assert [r.id for r in rows[1]] == ["D1:preamble", "D1:art:1"] and rows[1][0].text == "Stray"
    assert rows[2][0].cross_references == ["D2:art:6", "D2:art:16", "D2:art:8", "D2:art:9"]
    assert [r.id for r in rows[3]] == ["D3:art:1", "D3:art:1:para:3"] and rows[3][1].text == "5 percent"
    assert [r.id for r in rows[4]] == ["D4:art:1", "D4:annex:iv"] and rows[4][1].title == "T"
    assert rows[5][0].id == "D5:art:1" and rows[5][0].title == "A B"


ART_H = re.compile(r"(?i)^(?:Article|Art\.)\s+([0-9]+[a-z]?)$")
ART_I = re.compile(r"^(?:Article|Art\.)\s+([0-9]+[a-z]?)\s+([A-Z][a-z].*)$")
SUPP = re.compile(r"(?i)^(?:ANNEX|SCHEDULE)\s+([IVXLCDM0-9]+|[A-Z])$")
PARA = re.compile(r"^(?:(\d+)\.|\((\d+)\))\s*(.*)$")
REC = re.compile(r"(?i)^(?:\((\d+)\)|Whereas\s+)\s*(.*)$")


def read_through(text):
    """Line by line, one state at a time: (kind, number, title, text) of each part. Knows articles, annexes, recitals, paragraphs."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    parts, mode, count, i = [], "before", 0, 0
    while i < len(lines):
        x = lines[i]
        ahead = lines[i + 1] if i + 1 < len(lines) else None
        if m := SUPP.match(x):
            mode = "annex"
            takes = ahead is not None and not SUPP.match(ahead) and not ART_H.match(ahead)
            parts.append(["annex", m[1], ahead if takes else f"Annex {m[1]}", []])
            i += 1 + takes
            continue
        if mode == "annex":
            parts[-1][3].append(x)
        elif (m := ART_H.match(x)) or (m := ART_I.match(x)):
            inline = m.re is ART_I
            if mode == "before" and m[1] != "1" or inline and m[2].endswith("."):
                if parts:
                    parts[-1][3].append(x)
            else:
                takes = not inline and ahead is not None and not ART_H.match(ahead) and not SUPP.match(ahead) and not PARA.match(ahead)
                parts.append(["article", m[1], m[2] if inline else ahead if takes else f"Provision {m[1]}", []])
                mode = "in"
                i += takes
        elif mode == "before" and (m := REC.match(x)) and ((n := int(m[1]) if m[1] else count + 1) == count + 1 or count == 0):
            count = n
            parts.append(["recital", str(n), f"Recital ({n})", [m[2]] if m[2] else []])
        elif mode == "in" and (m := PARA.match(x)):
            n = m[1] or m[2]
            parts.append(["paragraph", n, f"Paragraph {n}", [m[3]] if m[3] else []])
        elif parts:
            parts[-1][3].append(x)
        else:
            parts.append(["preamble", "", None, [x]])
        i += 1
    out = [(k, n, t, "\n".join(b)) for k, n, t, b in parts]
    return [(k, n, t, b or (t if k == "article" else "")) for k, n, t, b in out if b or k == "article"]


def test_against_reading_in_order(spark):
    rng = random.Random(5)
    pool = ["Article 1", "Article 2", "Article 7", "Article 2 Scope of it", "Article 3 Ends here.", "ANNEX I", "ANNEX II", "Schedule B", "(1) first", "(2) second", "(3)", "Whereas it is so", "1. one", "2. two words", "some text", "More text.", "", "  padded  ", "Art. 1"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(1200)]
    got = {}
    docs = spark.createDataFrame([(i, f"D{i}", t) for i, t in enumerate(texts)], "doc_id long, short_name string, text string")
    for r in segment.segments(docs).orderBy("doc_id", "ord").select("doc_id", "chunk_type", "number", "title", "text").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    wrong = [(t, got.get(i, []), read_through(t)) for i, t in enumerate(texts) if got.get(i, []) != read_through(t)]
    assert not wrong, wrong[:2]


def test_running_headers(spark):
    lines = ["5.5.2017", "Page 1 of 50", "42", "L 117/175", "Official Journal of X", "EN", "draft", "Article 1 of it"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.h for r in df.select(segment.is_running_header(F.col("line")).alias("h")).collect()] == [True] * 7 + [False]
