import time

from hornbeam.llm import htmlmain

LONG = "A sentence of some length, with commas, that reads like the prose of an article and goes on for a while."


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>{body}</body></html>'


def test_article_without_its_surroundings():
    html = page(
        '<header class="site">Site</header><nav><ul><li><a href="/a">Menu one, two, three</a></li></ul></nav><div class="ad">Buy this, now, please, all of you who read.</div>'
        f'<article><h1>Title &amp; more</h1><p><b>First {LONG}<br><p>Second&nbsp;{LONG}</p><form><label>Name</label><input></form><aside>Side note</aside><section><p>Short.</p></section>'
        f'<div class="share">Share</div></article><section id="comments"><p>I disagree, strongly, {LONG}</p></section><footer>&copy; us</footer>'
    )
    assert htmlmain.main_text(html) == f"Title & more\nFirst {LONG}\nSecond {LONG}\nShort."


def test_no_article_element():
    html = page(f'<div id="nav"><a href="/">Home</a> <a href="/b">B</a></div><div class="content"><p>{LONG}</p><p>{LONG} Again.</p><ul><li>One</li><li>Two</li></ul></div><div class="sidebar"><p>{LONG} Not this.</p></div>')
    assert htmlmain.main_text(html) == f"{LONG}\n{LONG} Again.\nOne\nTwo"


def test_white_space_references_and_broken_markup():
    assert htmlmain.main_text(page("<article><p>a\n\t b&#233;&lt;c&gt; &am &amp d</p><p></p><p>e<p>f</article>")) == "a bé<c> &am & d\ne\nf"
    assert htmlmain.main_text("<article><p>cut off <b>he") == "cut off he"
    assert htmlmain.main_text("a < b and <c") == "a < b and <c"
    assert htmlmain.main_text("<article><p>x<!-- <p>no</p> -->y</p><script>if (a<b) '</p>'</script><p>z</p><a href='open>w</a></article>") == "xy\nz\nw"
    assert htmlmain.main_text(page('<article><p>k</p><div style="display: none">h</div><div hidden>h</div><div role="alert">n</div><div class="cookie-notice">c</div></article>')) == "k"


def test_named_link_lists_go_and_the_articles_own_stay():
    links = lambda what: "".join(f'<li><a href="/{k}">{what} number {k}</a></li>' for k in range(4))
    sources = "\n".join(f"Source number {k}" for k in range(4))
    html = page(f"<article><p>{LONG}</p><ul class='related'>{links('Story')}</ul><ol><li>Step one</li><li>Step <a href='/'>two</a> of it</li></ol><ul>{links('Source')}</ul></article>")
    assert htmlmain.main_text(html) == f"{LONG}\nStep one\nStep two of it\n{sources}"
    assert htmlmain.main_text(page(f"<div><p>{LONG}</p><p>{LONG} Again.</p><ul>{links('Page')}</ul></div>")) == f"{LONG}\n{LONG} Again."


def test_broken_pages_take_linear_time():
    began = time.time()
    for part in ("<div>x", '<a b="', "<a ", "</b>", "<p><span>", "<hr>", "<span><hr>", "<!--", "<script>", "<li><span>", "<table><td>", "<h1>", "<a '>"):
        htmlmain.main_text(page(f"<p>{LONG}</p>" + part * 100_000))
    assert time.time() - began < 90


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", "<p>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    got = sorted(htmlmain.extract(df).collect(), key=lambda r: r["page_id"] or 0)
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0), (LONG, len(LONG)), (LONG, len(LONG)), ("", 0), ("deep", 4)]
    assert htmlmain.extract(df.limit(0)).count() == 0
