"""Main text of generated pages with a known article, and of pages whose wrappers bear noise words."""

import random
import time

import pytest

from loomwork.llm import html_text as H

LONG = "A paragraph, with commas, and words enough to be the text of the page. " * 4
WRAPPERS = [
    '<article class="post comments-open">%s</article>',
    '<article class="promo-free post">%s</article>',
    '<div class="content has-sidebar">%s</div>',
    '<div class="post no-comments">%s</div>',
    '<div id="main-content" class="search-page">%s</div>',
    '<div class="share-story">%s</div>',
    '<form id="aspnetForm">%s</form>',
    '<div title="a hidden gem">%s</div>',
    '<div class="layout-sidebar"><h1>Head</h1>%s</div>',
]
NOISE = [
    '<div class="post-comments">%s</div>',
    '<div class="comments">%s</div>',
    '<section id="comments-section">%s</section>',
    '<ol class="comment-list"><li class="comment"><article class="comment-body">%s</article></li></ol>',
    '<div class="sidebar-left">%s</div>',
    "<div hidden>%s</div>",
    '<div style="display: none">%s</div>',
    "<div aria-hidden=true>%s</div>",
    "<nav>%s</nav>",
    '<div role="complementary">%s</div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_with_noise_words_are_no_noise(wrapper):
    page = f"<html><body><nav>menu</nav>{wrapper % f'<p>{LONG}</p>'}<footer>foot</footer></body></html>"
    assert H.extract(page).split("\n\n")[-1] == LONG.strip()


@pytest.mark.parametrize("noise", NOISE)
def test_longer_noise_is_dropped(noise):
    assert H.extract(f"<html><body><article><p>Short text.</p></article>{noise % f'<p>{LONG}</p>'}</body></html>") == "Short text."


def test_inner_wrapper_does_not_drop_the_heading():
    inner = f"<h1>Head</h1><p>Lead.</p><div class='body'><p>{LONG}</p><p>{LONG}</p></div>"
    want = f"Head\n\nLead.\n\n{LONG.strip()}\n\n{LONG.strip()}"
    for outer in ("<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>"):
        assert H.extract("<body>" + outer % inner + "</body>") == want


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n)).capitalize() + "."


def template(rnd):
    """A host's template: how its article is wrapped, and what else stands on its pages."""
    article = rnd.choice(["<article>%s</article>", '<article class="post-{i} hentry">%s</article>', '<div class="content"><div class="text">%s</div></div>', "<main><div class='entry'>%s</div></main>", '<section class="story comments-open">%s</section>'])
    wrapper = rnd.choice(["%s", '<div class="page has-sidebar">%s</div>', '<div id="wrap" class="no-ads">%s</div>', "<form id=f>%s</form>", '<div class="layout search-page">%s</div>'])
    around = [rnd.choice(['<div class="ad">%s</div>', "<nav><a href=/x>%s</a></nav>", "<aside>%s</aside>", '<div class="cookie-notice">%s</div>', '<div class="widget sidebar">%s</div>', "<header>%s</header>"]) for _ in range(3)]
    inside = rnd.choice(['<div class="share">%s</div>', '<ul class="comments"><li>%s</li></ul>', "<form><label>%s</label></form>", '<div class="related-posts"><p>%s</p></div>'])
    return article, wrapper, around, inside


def page(rnd, t, i):
    article, wrapper, around, inside = t
    blocks = [words(rnd, rnd.randint(25, 60)) for _ in range(rnd.randint(2, 5))]
    body = "".join(f"<p>{b.replace(' ', '  ', 1)}</p>" for b in blocks)
    head = words(rnd, 4)
    inner = f"<h1>{head}</h1>{body}" + inside % words(rnd, rnd.choice([3, 200]))
    noise = [a % words(rnd, rnd.choice([2, 20])) for a in around]
    html = f"<html><body>{noise[0]}{wrapper % (noise[1] + article.replace('{i}', str(i)) % inner)}{noise[2]}<footer>{words(rnd, 6)}</footer></body></html>"
    return html, "\n\n".join([head, *blocks])


def test_generated_pages(spark):
    rnd = random.Random(12)
    rows, want = [], {}
    for h in range(60):
        t = template(rnd)
        for i in range(6):
            html, text = page(rnd, t, i)
            want[len(rows)] = text
            rows.append((len(rows), f"https://h{h}.org/{i}", html, "x", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    wrong = [r["page_id"] for r in H.article_texts(df).collect() if r["text"] != want[r["page_id"]]]
    assert not wrong


def test_deep_and_broken_pages_cost_no_more_than_their_length():
    t = time.perf_counter()
    assert H.extract("<div>" * 60_000 + "deep" + "</section>" * 60_000 + "</div>" * 10) == "deep"
    assert H.extract("x <a" * 200_000 + " end").endswith("end")
    assert H.extract('<p class="' * 20_000) is not None
    assert time.perf_counter() - t < 20
