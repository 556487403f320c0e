"""Main text of pages."""

import time
from collections import Counter

import pytest

from wayfold.llm.html_text import bare_pages, Weights, best_part, default_weights, extract, labelled_pages, labelled_parts, main_text, op1_html_text, read_page

W = default_weights()

CASES = [
    (None, ""),
    ("", ""),
    ("plain text only", "plain text only"),
    ("<nav><a>a</a></nav><div class='ad'>buy this now</div><footer>f</footer>", ""),
    ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>menu</a></li></ul></nav><!-- c --><div class=\"ad\">buy this</div>"
     "<article><h1>A &amp; B&nbsp;C</h1><p><b>one  \n two<br><p>three &lt;x&gt;</p><div class='ad'>in the middle there is a long advert</div><p>end</p></article><footer>&copy; me</footer>",
     "A & B C\none two\nthree <x>\nend"),
    ("<body><header class='site-header'>Site name</header><main><article class='post has-sidebar'><header><h1>T</h1></header><p>x &#233; &#x1F600;</p><aside>side</aside><form><label>Mail</label><input></form>"
     "<section class='comments'><article class='comment'><p>first comment, a long one by a reader of the page</p></article></section></article></main><div id='cookie-notice'>We use cookies</div>",
     "T\nx é \U0001f600"),
    ("<div class='navbar'>Home</div><div class='content'><h1>T</h1><p>" + "word " * 50 + "</p><ul><li>i</li><li>j</li></ul><table><tr><td>1</td><td>2</td></tr></table></div><div class='sidebar'><p>" + "side " * 80 + "</p></div>",
     "T\n" + " ".join(["word"] * 50) + "\ni\nj\n1 2"),
    ("<article><p>before</p><p hidden>no</p><p style='display:none'>no</p><noscript>no</noscript><template><p>no</p></template><p>a<b>b</b>c < d</p></article>", "before\nabc < d"),
    ("<article><p>broken <div class='ad'>x</article><p>tail", "broken"),
    ("<article><script>if (a<b) document.write('<p>')</script><p>fine</p>", "fine"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_cases(source, want):
    assert main_text(source, W) == want


ARTICLE = "<html><body><nav><ul><li><a>menu</a></li></ul></nav><article><h1>T</h1><p>" + "Word here now. " * 20 + "</p>{}<p>" + "More words. " * 20 + "</p></article><div>nine word promo here for you to buy now</div><footer>f</footer></body></html>"


@pytest.mark.parametrize("inner,want", [
    ("<h2 id='discussion'>Discussion</h2>", "Discussion"), ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<p class='warning'>Take care.</p>", "Take care."),
    ("<table class='menu'><tr><td>Soup</td><td>3</td></tr></table>", "Soup 3"), ("<address>A street 5</address>", "A street 5"), ("<center>In the middle</center>", "In the middle"),
    ("<p><a href='x'>only a link</a></p>", "only a link"), ("<div class='ad'>Buy now, cheap and good!</div>", None), ("<div class='share'><a>send</a></div>", None), ("<aside>See also that</aside>", None),
])
def test_inside_an_article(inner, want):
    lines = main_text(ARTICLE.format(inner), W).split("\n")
    assert lines == ["T", ("Word here now. " * 20).strip(), *([want] if want else []), ("More words. " * 20).strip()]


@pytest.mark.parametrize("around", ["<form action='x'>{}</form>", "<div class='layout-sidebar'>{}</div>", "<div class='content-with-sidebar'>{}</div>"])
def test_wrappers_of_a_page_are_no_reason_to_drop_it(around):
    for inner in ("<article>{}</article>", "<div>{}</div>"):
        page = "<body><nav><ul><li><a>menu</a></li></ul></nav>" + around.format(inner.format("<h1>Title</h1><p>" + "Word here now. " * 30 + "</p>")) + "</body>"
        assert main_text(page, W) == "Title\n" + ("Word here now. " * 30).strip()


def test_a_short_article_beats_a_longer_promo():
    assert main_text("<body><div>nine words of promo here for you to buy</div><article><p>Three word article</p></article></body>", W) == "Three word article"


def test_the_scan_alone_leaves_boilerplate_out():
    """Without any evidence of tags' and elements' names, words, link text and tag costs find the article."""
    bare = Weights({"": W.around[""]}, W.block, W.cost)
    menu = "<div><a>one</a> <a>two</a> <a>three</a> <a>four</a></div>"
    body = "<h1>The title of it</h1><p>" + "Some words of prose. " * 10 + "</p><p>" + "And others here. " * 10 + "</p>"
    want = "The title of it\n" + ("Some words of prose. " * 10).strip() + "\n" + ("And others here. " * 10).strip()
    assert main_text(f"<body>{menu * 3}<div>{body}</div>{menu * 3}</body>", bare) == want


def test_scan_finds_the_best_run():
    import random

    rng = random.Random(5)
    for _ in range(500):
        score = [rng.choice((-3.0, -1.5, -0.25, 0.0, 0.5, 2.0)) for _ in range(rng.randint(0, 14))]
        sums = [sum(score[i:j]) for i in range(len(score)) for j in range(i, len(score) + 1)]
        start, end = best_part(score)
        assert sum(score[start:end]) == pytest.approx(max([0, *sums]))


def test_held_out_layouts():
    """On layouts made anew, nearly all words of articles are found and nearly no others."""
    found = right = wanted = 0
    for source in labelled_pages(150, seed=99):
        page = read_page(source)
        want = [w for p, on in zip(page.parts, labelled_parts(page), strict=True) if on and not p.kind and not page.elements[p.element].hidden for w in p.text.split()]
        got = main_text(source, W).split()
        both = sum((Counter(want) & Counter(got)).values())
        found, right, wanted = found + len(got), right + both, wanted + len(want)
    assert right / wanted > 0.97 and right / found > 0.97


@pytest.mark.parametrize("piece", ["<a x", '<a x="', "<div></p>", "<div></span>", "<ul><li>", "<!--", "<script>", "<p><div>", "<b><i>", "& ", "<", "<textarea>", "<title>", "<noscript>", "<template>", "<iframe>", "<svg>", "<TITLE x>"])
def test_broken_markup_takes_linear_time(piece):
    source = piece * (1_000_000 // len(piece))
    start = time.process_time()
    main_text(source[:100_000], W)
    small = time.process_time() - start
    start = time.process_time()
    main_text(source, W)
    assert time.process_time() - start < 30 * small + 1


BARE = [
    ("Hello world this is a plain text page with no tags at all.", "Hello world this is a plain text page with no tags at all."),
    ("<div>Hello world this is a plain text in a div.</div>", "Hello world this is a plain text in a div."),
    ("<body>Hello world this is a text.<br>More of it follows here, and a little more besides</body>", "Hello world this is a text.\nMore of it follows here, and a little more besides"),
    ("<body><h1>Title</h1>These are twenty odd words that stand straight in the body of a page, as old pages have them.", "Title\nThese are twenty odd words that stand straight in the body of a page, as old pages have them."),
    ("word", "word"), ("<p>One.</p>", "One."), ('<a href="x">Home</a> | <a href="y">About</a>', ""),
    ('<body><a href="x">Home</a> | <a href="y">About us</a><br><br>A text that is long enough to be an article by itself.<hr><a href="z">Top</a>', "A text that is long enough to be an article by itself."),
    ("<div hidden><p>Not <ul><li>shown here.</ul></div><p>Shown here, a sentence.", "Shown here, a sentence."),
    ("<ul><li>First point of a list.<li>Second point of it.</ul>", "First point of a list.\nSecond point of it."),
]


@pytest.mark.parametrize("source, text", BARE)
def test_bare_pages_keep_their_text(source, text):
    assert main_text(source, W) == text


def test_held_out_bare_pages():
    found = right = wanted = 0
    for source in bare_pages(200, seed=77):
        page = read_page(source)
        want = [w for p, on in zip(page.parts, labelled_parts(page), strict=True) if on and not p.kind and not page.elements[p.element].hidden for w in p.text.split()]
        got = main_text(source, W).split()
        both = sum((Counter(want) & Counter(got)).values())
        found, right, wanted = found + len(got), right + both, wanted + len(want)
    assert right / wanted > 0.97 and right / found > 0.95


def test_table(spark):
    rows = [(i, f"u{i}", h, "old") for i, (h, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string, text string")
    out = op1_html_text(df).collect()
    assert len(out) == len(rows) + 3
    for r in out:
        assert r["text"] == CASES[r["page_id"]][1] and r["n_chars"] == len(r["text"])
    assert extract(df).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert op1_html_text(df.limit(0)).count() == 0
