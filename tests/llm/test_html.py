"""Templates of pages by different pages of a host."""

import time

from provisio.llm import html


def test_templates_by_different_pages(spark):
    block = "<div><p>Block of some pages</p></div>"
    rows = [(i, f"http://hot.example/{i}", f"<body>{block if i < 10 else ''}<p>Own {i}</p></body>") for i in range(100)]  # on a tenth of the pages
    rows += [(200 + i, "http://copies.example/", "<body><div><p>Only text of one page</p></div><section>More</section></body>") for i in range(5)]
    rows += [(300 + i, f"http://copies.example/{i}", f"<p>Other {i}</p>") for i in range(20)]
    rows += [(400 + i, "http://only.example/", f"<body><!-- {i} --><article><div>Shared {'' if i else 'and all'}</div></article><p>{i}</p></body>") for i in range(8)]
    side = "<section>Seen beside and inside articles</section>"
    rows += [(500 + i, "http://side.example/", f"<body>{side}<article><p>Own {i}</p>{side if i == 0 else ''}</article></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert len(got) == len(rows) and all(got[i] == f"Own {i}" for i in range(100))
    assert all(got[200 + i] == "Only text of one page\nMore" for i in range(5))
    assert [got[400 + i] for i in range(8)] == ["Shared and all", *["Shared"] * 7]
    assert all(got[500 + i] == f"Own {i}" for i in range(6))


def one(page, templates=frozenset()):
    return html.main_text(html.parse(page), templates)


def test_comments_and_hidden_parts_go():
    assert one("<article><p>Main.</p></article><article class='comment'><p>Reader says hi</p></article>") == "Main."
    assert one("<article><p>Main.</p><section id=comments><article>Hi</article></section></article><article hidden>x</article>") == "Main."
    assert one("<article><p>Main.</p><p style='color:red; display : none'>x</p><div aria-hidden=true>y</div></article>") == "Main."


def test_furniture_words_in_names_of_content():
    page = "<article><p>A</p><div class='share-price'>12</div><div id='social-history'>B</div><div class='header-note'>C</div><div class='share-buttons x'>no</div><div class='ad'>no</div></article>"
    assert one(page) == "A\n12\nB\nC"


def frame_pages(n, host):
    """Menu, advert and footer with other words on each page, as many sites have them; no tag or class that lists know but nav."""
    return [(f"http://{host}/{i}", f"<body><div class='zq'><ul>{''.join(f'<li><a>m{i}{k}</a></li>' for k in range(3 + i % 3))}</ul></div><div class='qx-{i}'>Buy {i}</div><article><h1>T{i}</h1><p>Own {i}</p></article><div class='foot'>f{i}</div>") for i in range(n)]


def test_frames_of_a_hot_host_alone_leave_the_article(spark):
    rows = [(i, *x) for i, x in enumerate(frame_pages(60, "hot.example") + frame_pages(3, "few.example"))] + [(100 + i, f"http://h{i}.example/", "<p>x</p>") for i in range(120)]
    templates = html.template_hashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    hashes = {r.digest for r in templates.where("host = 'hot.example'").collect()}
    assert not templates.where("host = 'few.example'").count()
    for i, (_, page) in enumerate(frame_pages(60, "hot.example")):
        assert html.text_of(html.parse(page), hashes, lists=False) == f"T{i}\nOwn {i}"


def test_joined_templates_give_the_same(spark, monkeypatch):
    rows = [(i, *x, 7) for i, x in enumerate(frame_pages(20, "a.example") + [(None, None), (None, ""), ("u", "<div><a>1</a></div>")] + frame_pages(1, "b.example") * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    want = sorted(map(repr, html.extract(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", 0)
    assert len(want) == len(rows) and sorted(map(repr, html.extract(df).collect())) == want
    assert html.extract(df.limit(0)).count() == 0


def test_quotes_outside_values():
    assert one('<p class=x">Hello</p><p>there</p> <p>"quoted" text</p>') == 'Hello\nthere\n"quoted" text'
    assert one("<p data-x=it's>One</p><p>Two</p><p title='a>b' \"=c>Three</p>") == "One\nTwo\nThree"
    assert one("<p a = 'x' b= \"y>z\" c>One</p><a href=/x/>two</a>") == "One\ntwo"


def test_forms_and_labels():
    assert one("<form id=aspnetForm><article><p>Text</p></article></form>") == "Text"
    assert one("<p>Long enough text of the page.</p><form><p>Name</p><input></form>") == "Long enough text of the page."
    assert one("<form><div><p>Nearly all words of this page</p></div></form><p>x</p>") == "Nearly all words of this page\nx"
    assert one("<p>The <label>labelled</label> word</p><label for=m>Menu</label>") == "The labelled word"


def test_layout_classes_and_headers():
    assert one("<article class='main sidebar'><p>Text</p></article>") == "Text"
    assert one("<div class='page sidebar'><article><p>All the text there is</p></article></div><div class=sidebar>no</div>") == "All the text there is"
    assert one("<header>Site</header><article><header><h1>Headline</h1></header><p>Text</p><footer>no</footer></article>") == "Headline\nText"
    assert one("<main><h1>Title</h1><article><p>Text</p></article></main>") == "Title\nText"


def test_reader_comments_and_teasers():
    for name in ("reader-comments", "user-comments", "post-comments", "comment-7", "all_comments x"):
        assert one(f"<article><p>A</p><div class='{name}'><p>hi</p></div><p>B</p></article>") == "A\nB", name
    assert one("<article class='post has-comments'><p>A</p></article>") == "A"
    assert one("<main><article><p>The long text of the page itself</p></article><section><h2>Related</h2><article><p>Other</p></article></section></main>") == "The long text of the page itself"


def test_deep_and_stray_tags_take_linear_time():
    began = time.perf_counter()
    n = 50_000
    for page in ("<div>" * n + "x" + "</b>" * n, "<td><b>" + "<i>" * n + "<td>" + "</b>" * n + "x", "<b><table><td>" + "<span>" * n + "x" + "</b>" * n, "<div>" * n + "<p>x" * 10 + "</p>" * n, "<ul>" + "<span>" * n + "<li>x" * 10, "<p " + "a='" * n + ">x"):
        root = html.parse(page)
        html.candidates(root)
        assert html.main_text(root, frozenset({1})) is not None
    assert time.perf_counter() - began < 20


def test_templates_by_counting(spark):
    """Templates are what a plain count over different pages finds."""
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div class=a>menu</div><section><p>{'often' if i % 3 else i}</p></section><article><p>{i}</p></article></body>", "x", 1) for i in range(24)]
    df = spark.createDataFrame([*rows, *rows[:4], (99, None, None, "x", 1)], "page_id long, url string, html string, host string, digest int")
    seen = {}
    for _, url, page, *_ in rows:
        root = html.parse(page)
        for d in html.candidates(root):
            seen.setdefault((url.split("/")[2], d), set()).add(root.digest)
    want = {k for k, v in seen.items() if len(v) >= html.LEAST_PAGES}
    assert {(r.host, r.digest) for r in html.template_hashes(df).collect()} == want and want
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[i] == str(i) for i in range(24)) and got[99] == ""
    assert html.extract(df.limit(0)).count() == 0
