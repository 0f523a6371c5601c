"""Main texts of pages: articles in main, copies of pages, hosts of few pages."""

import math
import time
from collections import Counter

import pytest

from estimora.llm import html_main


def text(source):
    return html_main.main_text(html_main.page_of(source), set())


def texts(spark, pages):
    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)]
    found = {r["page_id"]: r["text"] for r in html_main.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [found[k] for k in range(len(pages))]


def test_article_in_main():
    assert text("<body><main><article><h1>T</h1><p>One</p><article>reply</article></article></main></body>") == "T\n\nOne"
    assert text("<main><article><p>One</p></article><article><p>Two</p></article></main>") == "One\n\nTwo"
    assert text("<main><header><h1>T</h1></header><p>Story</p><section class=comments><article>me too</article></section></main>") == "T\n\nStory"
    assert text("<main><p>A long story of its own</p><article>teaser</article></main>") == "A long story of its own\n\nteaser"


def test_class_words_are_evidence():
    """Compound names count as a whole; a branch with most of an article's text stays, whatever it is called."""
    article = lambda inner: text(f"<article><h1>Title of it</h1><p>A first paragraph</p>{inner}</article>").removeprefix("Title of it\n\nA first paragraph").strip()
    for kept in ('class="social-science"', 'id="notice-period"', 'class="comments-title"', 'class="shared x"', 'class="adventure"', 'class="replying"'):
        assert article(f"<div {kept}>stays</div>") == "stays", kept
    for gone in ('class="ad"', 'class="x cookie-notice"', 'id="comments"', 'class="post-comments"', 'class="sidebarLeft"', 'id="ad_300"', 'role="complementary"', "hidden", 'class="related-posts"'):
        assert article(f"<div {gone}>goes</div>") == "", gone
    assert text(f'<article><h1>T</h1><div class="social"><p>{"whole story " * 9}</p></div></article>').endswith("story")
    assert text('<body><div class="sponsored"><article><p>Story</p></article></div><p>beside</p></body>') == "Story"
    assert text('<body><div class="ad">only this</div></body>') == ""


def test_articles_in_articles():
    assert text("<article><article><p>All of it</p></article></article>") == "All of it"
    assert text("<article><p>Post</p><div><article>a very long comment on it</article></div></article>") == "Post"


@pytest.mark.parametrize("deep", ["<div>" * 100_000 + "<p>x", "<div>x" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000 + "x", "<table><td>" + "<i>" * 50_000 + "</table-x></p>" * 50_000 + "x", "<ul><li><div>" * 20_000 + "x", "<div>" * 50_000 + "<li>x</li>" * 50_000, "<p " * 20_000 + "x"])
def test_deep_and_long_pages(deep):
    began = time.monotonic()
    page = html_main.page_of(deep)
    assert html_main.style_rows(page) is not None and html_main.main_text(page, {1}).count("x") > 0
    assert time.monotonic() - began < 20


def test_one_article_on_many_pages(spark):
    """An article that all pages of a host share, in a branch of its own, stays on each."""
    page = lambda k: f'<title>{k}</title><body><nav>Menu</nav><article><div class="body"><p>The same article on each page</p><p>and more of it</p></div></article></body>'
    for n in (2, 19, 20, 60):
        assert texts(spark, [page(k) for k in range(n)]) == ["The same article on each page\n\nand more of it"] * n
        assert texts(spark, [page(0)] * n) == ["The same article on each page\n\nand more of it"] * n


def test_the_tree_decides(spark):
    """On a host with boxes of no telling name, texts come out right through the tree alone."""
    def page(k):
        box, rail = "<div class=kx7><p>Join 40,000 readers</p><p>Enter your address</p></div>", f"<div class=rr><p>Most read</p><ul><li>One story<li>Another story {k % 2}</ul></div>"
        return f"<html><body><div class=top><p>The Daily Page</p><p>News Sport Weather</p></div>{rail}<div class=text><h1>Story {k}</h1><p>What happened on day {k}</p>{box}<p>The end {k * 3}</p></div><div class=end>About us</div></body></html>"

    pages = [page(k) for k in range(40)]
    assert texts(spark, pages) == [f"Story {k}\n\nWhat happened on day {k}\n\nThe end {k * 3}" for k in range(40)]
    assert all("Daily Page" in text(p) and "40,000" in text(p) for p in pages)


def test_copies_of_pages_count_once(spark):
    """Pages without an article keep their texts, however often each is there; what repeats over them goes."""
    page = lambda k: f'<body><div class="x1">Buy now</div><div class="x2"><p>Text {k} of its own</p><ul><li>Item {k}</ul></div></body>'
    own = lambda k: f"Text {k} of its own\n\nItem {k}"
    copies = [0] * 60 + list(range(1, 30))
    assert texts(spark, [page(k) for k in copies]) == [own(k) for k in copies]
    assert texts(spark, [page(0)] * 25) == ["Buy now\n\n" + own(0)] * 25
    assert all(t.endswith(own(k % 5)) for k, t in enumerate(texts(spark, [page(k % 5) for k in range(200)])))


def test_body_is_not_judged(spark):
    """Bodies that are alike but for what they are called stay."""
    pages = [f"<html><head><title>{k}</title></head><body>Same words</body></html>" for k in range(30)]
    assert texts(spark, pages) == ["Same words"] * 30


def test_hosts_of_few_pages(spark):
    """What repeats on all pages goes from three distinct pages on, as on hosts of many; versions of one article stay."""
    page = lambda k: f'<body><div class="x1">Buy now at our shop</div><article><p>Text {k}</p><div class="q">Same</div><ul><li>Item {k}</ul></article></body>'
    plain = lambda k: page(k).replace("article", "div")
    for n in (3, 8, 19, 20, 21):
        assert texts(spark, [page(k) for k in range(n)]) == [f"Text {k}\n\nItem {k}" for k in range(n)]
    assert texts(spark, [plain(k) for k in range(4)]) == [f"Text {k}\n\nItem {k}" for k in range(4)]
    assert texts(spark, [page(k) for k in range(2)]) == [f"Text {k}\n\nSame\n\nItem {k}" for k in range(2)]
    versions = [f'<article><p>Text {k}</p><table class="t{max(k, 2)}"><td>Cell {max(k, 2)}</table></article><!-- {k} -->' for k in range(9)]
    versions[:3] = [f'<article><p>Text {k}</p><table class="t2"><td>Cell 2</table></article>' for k in range(3)]
    assert texts(spark, versions)[:3] == [f"Text {k}\n\nCell 2" for k in range(3)]


def test_what_articles_of_a_host_share_stays(spark):
    """Headings, lists, quotes and captions that are equal on all pages of a host are parts of articles."""
    page = lambda k: f'<body><nav><a href=/>Home</a></nav><article><h1>Dish {k}</h1><div class="body"><h2>Ingredients</h2><p>own {k}</p><ul><li>Salt</li></ul><blockquote>Eat well</blockquote><figure><figcaption>As served</figcaption></figure><table><tr><td>Grams</td></tr></table><h2>Method</h2><p>cook {k} times</p></div></article></body>'
    want = lambda k: f"Dish {k}\n\nIngredients\n\nown {k}\n\nSalt\n\nEat well\n\nAs served\n\nGrams\n\nMethod\n\ncook {k} times"
    assert texts(spark, [page(k) for k in range(12)]) == [want(k) for k in range(12)]


def test_names_need_a_second_sign(spark):
    long = "words of a long story " * 30
    of = lambda inner: text(f"<article><h1>T</h1><p>{long}</p>{inner}</article>").removeprefix("T\n\n" + long.strip()).strip()
    assert of('<section class="recommended"><p>Recommended dose is 5 mg</p></section>') == "Recommended dose is 5 mg"
    assert of('<p id="comments">Comments on the treaty</p>') == "Comments on the treaty"
    assert of('<p>He <span class="comment">said</span> it</p>') == "He said it"
    assert of('<div class="related"><a href=/a>Another story</a> <a href=/b>One more</a></div>') == ""
    assert of('<div class="notice"><p>Notice period: <a href=/x>a</a> month of grace</p></div>') == "Notice period: a month of grace"
    assert of('<section class="comments"><p>Great!</p></section>') == "" == of('<ul class="share"><li><a href=/f>Post</a></ul>')
    page = lambda k: f'<article><h1>T {k}</h1><p>{long}{k}</p><div class="related"><p>Our best offers</p></div><div class="more"><p><a href=/o>Our best offers</a></p></div></article>'
    assert all("offers" not in t for t in texts(spark, [page(k) for k in range(5)]))


def test_entropies_by_force(spark):
    """What the tree removes, against entropies computed page by page."""
    def page(k):
        return f'<body><div class=a>Same</div><div class=b>{"xy"[k % 2]}</div><div class=c>{k}</div>{"<div class=d><p>Rare</div>" if k < 2 else ""}{"<div class=e>Half</div>" if k % 2 else ""}<div class=f>{k // 5}<i></i>{"<p>z" * (k % 3)}</div></body>'

    hosts = {"h.example": [page(k) for k in range(20)] + [page(0)], "i.example": [page(k) for k in (1, 2, 3)], "j.example": [page(4), page(5)]}
    want = set()
    for host, pages in hosts.items():
        seen, total = {}, len(set(pages))
        for source in set(pages):
            for path, content, shape in html_main.style_rows(html_main.page_of(source)):
                seen.setdefault(path, []).append((content, shape))
        for path, values in seen.items():
            m, importance = len(values), 0.0
            for kind, weight in ((0, 0.7), (1, 0.3)):
                counts = Counter(v[kind] for v in values)
                importance += weight * (-sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m) if m > 1 else 1)
            if importance + html_main.DOUBT / m < html_main.LEAST_IMPORTANCE and m * m >= total * html_main.LEAST_SHARE:
                want.add((host, path))
    rows = [(host, p) for host, pages in hosts.items() for p in pages]
    found = {tuple(r) for r in html_main.removed_styles(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert found == want and want
