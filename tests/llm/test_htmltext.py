import html
import re

from kinfold.llm import htmltext as h

SF = "/root/testdata/sf0.01"


def text(page, *others):
    lines = h.parse(page)
    return h.main_text(lines, h.signature(lines), [h.signature(h.parse(o)) for o in others])


def test_all_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in h.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_structure():
    page = """<html><head><title>T</title><script>var x = "</p>";</script></head><body>
    <header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><ul class=menu><li>Home</ul>
    <main><article><header><h1>Head &amp; line</h1></header><p>One <b>bold<p>Two&nbsp;2 &#65;<br>more</p>
    <ul><li>a<li>b</ul><div class="share-buttons">Share</div><aside>side</aside><form>f<input></form>
    <table><tr><td>x</td><td>y</td></tr></table><p>5 < 6</p></article>
    <section id="comments"><article><p>First!</p></article></section></main><footer>foot</footer>"""
    assert text(page).split("\n\n") == ["Head & line", "One bold", "Two 2 A more", "a", "b", "x y", "5 < 6"]


def test_differencing_finds_the_template():
    page = "<body><div>Acme daily</div><div><p>{}</p><p>{}</p></div><div>All rights reserved</div></body>"
    a, b = page.format("Alpha story.", "It goes on."), page.format("Beta story.", "Another end.")
    assert text(a, b) == "Alpha story.\n\nIt goes on." and text(a) == "Acme daily\n\nAlpha story.\n\nIt goes on.\n\nAll rights reserved"
    assert text(a, a) == text(a)  # a copy is no evidence
    article = "<body><p>Menu line</p><article><p>Shared passage.</p><p>{}</p><p><a href=x>Next story</a></p></article></body>"
    assert text(article.format("Own."), article.format("Other.")) == "Shared passage.\n\nOwn."


def test_marks_in_subjects_are_prose():
    page = """<body><div class="nav-bar">Menu</div><article class="post category-social-media"><h1>Title</h1><h2 id="social-effects">Social effects</h2><p>One.</p>
    <section id="related-work"><h2 id="search">Search</h2><p>Two.</p></section><section id="notice"><p>Three.</p></section><p><span id="Copyright">Four.</span></p>
    <div class="comment-culture"><p>Five.</p></div><div class="share-buttons">Share</div><div class="newsletter">Join</div><ul id="comments"><li>Hm</ul><div role="search">Find</div></article>
    <div class="social">Follow</div></body>"""
    prose = ["Title", "Social effects", "One.", "Search", "Two.", "Three.", "Four.", "Five."]
    assert text(page).split("\n\n") == prose
    other = page.replace("One.", "1.").replace("Two.", "2.")
    assert text(page, other).split("\n\n") == prose[:-1]  # a neighbour confirms the doubt
    for whole in ("social", "post promotion"):
        assert text(f'<body><article class="{whole}"><p>Body.</p></article></body>') == "Body."
    assert text('<main><p>Body.</p><article class="social"><p>More.</p></article></main>') == "Body.\n\nMore."
    assert text('<body><div class="post category-social-media"><p>Body.</p></div><div class="social-media">x</div></body>') == "Body."
    assert text('<body><main><section id="related-work"><p>Body.</p></section><h2 id="search-terms">Terms</h2></main></body>') == "Body.\n\nTerms"
    assert text('<body><p>Body.</p><h2 id="social">Social</h2><section id="related-work">Work.</section><div id="social-box">x</div></body>') == "Body.\n\nSocial\n\nWork."


def test_all_free_articles_are_kept():
    two = "<article><p>Part one.</p></article><p>Menu</p><article><p>Part two is longer.</p></article>"
    assert text(f"<body>{two}</body>") == "Part one.\n\nPart two is longer."
    assert text(f'<body><div class="has-sidebar">{two}</div></body>') == "Part one.\n\nPart two is longer."
    assert text('<body><div class="story">Part one.</div><div>Menu</div><div class="story">Part two.</div></body>') == "Part one.\n\nPart two."
    aside = "<aside><article>Card 1</article><article>Card 2</article></aside>"
    assert text(f'<body>{aside}{two}{aside}<article class="teaser">Card 3</article><div class="post-tags">Tags</div></body>') == "Part one.\n\nPart two is longer."


def test_common_subsequence():
    assert h.shared_lines([1, 2, 3, 4], [9, 2, 4, 3]) in ({1, 2}, {1, 3})
    assert h.shared_lines([1, 2, 3], [1, 2, 3]) == {0, 1, 2} and h.shared_lines([], [1]) == set()
    assert len(h.shared_lines([5] * 2000, [5] * 1500)) == 1500


def test_unclosed_advert_ends_at_the_article():
    assert text("<body><div class='ad'>buy<article><p>Body</p></article>") == "Body"
    assert text("<p>plain") == "plain" and text("no tags at all") == "no tags at all" and text("<div hidden>x</div>y") == "y"


def test_odd_rows(spark):
    page = "<article><p>Body {}</p></article>"
    rows = [(1, "http://a.org/1", None, 0), (2, "http://a.org/2", "", 0), (None, None, page.format(1), 0), (4, "http://a.org/x", page.format("🎉"), 0), (4, "http://a.org/x", page.format("🎉"), 0), (5, "not a url", "<p>" * 3000 + "deep", 0), (6, "http://a.org/long", page.format("word " * 50_000), 0)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    got = sorted((str(r["page_id"]), r["text"][:8], r["n_chars"]) for r in out)
    assert got == [("1", "", 0), ("2", "", 0), ("4", "Body 🎉", 6), ("4", "Body 🎉", 6), ("5", "deep", 4), ("6", "Body wor", 250_004), ("None", "Body 1", 6)]
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_neighbours_stream_over_a_large_host(spark):
    page = "<body><div>Shop header</div><p>Article number {0} is here.</p><p>Line {0} two.</p><div>Shop end</div></body>"
    rows = [(i, f"https://shop.example/a/{i:05d}.html", page.format(i)) for i in range(400)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 400 and all(r["text"] == f"Article number {r['page_id']} is here.\n\nLine {r['page_id']} two." for r in out)


def test_texts_do_not_depend_on_the_partitions(spark):
    """Without an article differencing decides; cells, not partitions, say who is a neighbour."""
    page = "<body><div>Shop {1}</div><p>Article {0} is here.</p><p>{1} in all.</p><div>Shop end</div></body>"
    rows = [(i, f"https://shop.example/a/{i:05d}.html", page.format(i, i // 3)) for i in range(300)]
    rows += [(None, "https://shop.example/a/00100.html", page.format("x", 7))] * 40 + [(100, "https://shop.example/a/00100.html", page.format(k, k)) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    small = h.Settings(cell=8)
    texts = [sorted(map(str, h.extract(df, small, p).collect())) for p in (1, 5, 40)]
    assert texts[0] == texts[1] == texts[2] and len(texts[0]) == len(rows)
    assert len({len(x) for x in texts[0]}) > 1
    # Against the same cells in plain Python.
    keyed, bounds = h._bounds(h.keyed(df), small, 1000)
    starts = {h._key(r["host"], r["path"], r["page_id"]) for r in keyed.where("start").collect()}
    assert len(bounds) == len(starts) > 20
    cells, want = [], []
    for r in sorted(keyed.collect(), key=lambda r: (h._key(r["host"], r["path"], r["page_id"]), h.zlib.crc32(r["html"].encode()))):
        key = h._key(r["host"], r["path"], r["page_id"])
        if not cells or key in starts and key != cells[-1][-1][0]:
            cells.append([])
        cells[-1].append((key, r, h.parse(r["html"])))
    for cell in cells:
        signs = [h.signature(lines) for _, _, lines in cell]
        for i, (_, r, lines) in enumerate(cell):
            near = sorted((j for j in range(max(0, i - 2), min(len(cell), i + 3)) if j != i), key=lambda j: abs(j - i))[:2]
            t = h.main_text(lines, signs[i], [signs[j] for j in near])
            want.append(str((r["page_id"], r["url"], t, len(t))))
    got = sorted(str((r["page_id"], r["url"], r["text"], r["n_chars"])) for r in h.extract(df, small).collect())
    assert got == sorted(want)


def test_packed_lines_come_back():
    lines = h.parse("<body><nav>Menu</nav><p>A<p>B <a href=x>c</a><article><p>D</p></article>")
    signs, back = h.unpacked(*h.packed(lines))
    assert signs == h.signature(lines) and h.main_text(back, signs, []) == h.main_text(lines, signs, []) == "D"
    assert h.unpacked(*h.packed([])) == ([], [])
