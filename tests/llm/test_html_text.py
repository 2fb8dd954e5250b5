import random
import time
from collections import Counter

import pytest

from objekta.llm import html_text
from objekta.llm.html_text import extract, main_text

ARTICLE = "<h1>A title &amp; more</h1><p>First part, with <b>bold</b>, commas. And <a href=x>a link</a> in it.<p>Second\n  part, longer than the first one. It has two sentences.</p>"
WANT = "A title & more First part, with bold, commas. And a link in it. Second part, longer than the first one. It has two sentences."
AROUND = (
    "<html><head><title>No</title><style>p{x}</style></head><body class=page><header><h2>Site</h2></header><nav><ul><li><a href=1>Menu one</a><li><a href=2>Menu two</a></ul></nav>"
    "<div class='ad'>Buy this, now. It is cheap.</div>{}<aside>Side, text. Here.</aside><div id=comments><p>A reader says this, and that. And more.</p></div>"
    "<form><p>Name, please. Then mail.</p></form><script>if (a < b) document.write('<p>x</p>')</script><div class='cookie-notice'>We use cookies, sorry. Fine.</div><footer>Copyright, us. All rights.</footer></body></html>"
)


def test_articles_in_several_wrappers():
    for wrap in ("<article>{}</article>", "<main><div>{}</div></main>", "<div id=content>{}</div>", "<div class='post'><div class=body>{}</div></div>", "<article>{}<div class='comments'><p>So long, thanks. Bye.</p></div></article>", "<table><tr><td>{}</td></tr></table>", "<div class='layout no-sidebar'><article>{}</article></div>", "<div id=page class='with-sidebar'><div class=text>{}</div></div>", "<article><div class='article-header'></div>{}</article>"):
        assert main_text(AROUND.replace("{}", wrap.replace("{}", ARTICLE))) == WANT, wrap


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>a, b. c</nav>") == ""
    assert main_text("plain &lt;text&gt;, only.") == "plain <text>, only."
    assert main_text("<p>a, b<br>c.<!-- no --><p>d &#233;&nbsp;f") == "a, b c. d é f"
    assert main_text("<article><p>short.</p></article>") == "short."
    assert main_text("<article><p>One, two. Three.</p></article><div class=comments><article class=comment><p>A reader, says. This.</p></article></div>") == "One, two. Three."
    assert main_text("<form><p>All of it, in a form. Yes.</p></form>") == "All of it, in a form. Yes."
    assert main_text("<p class='x\">unclosed, quote. here<p>more") != ""
    assert main_text("<article>" + "<p>word, word. word</p>" * 20000 + "</article>").count("word, word.") == 20000
    assert main_text("<div>" * 3000 + "<p>deep, text. here</p>") == "deep, text. here"


def test_pages_without_article_or_main_keep_all_parts():
    part = "<p>The first part, with words, and more. It goes on, and on, for long.</p>" * 12
    last = "<p>The last part, shorter. But whole.</p>"
    page = f"<body><div id=content><div class=part>{part}</div><div class=other>{last}</div></div></body>"
    assert main_text(page).endswith("for long. The last part, shorter. But whole.")
    page = f"<body><div id=content><h2>Title</h2><p class=lead>Lead</p>{part}<ul><li>one</li><li>two</li></ul><pre>x = 1</pre></div></body>"
    assert main_text(page).startswith("Title Lead The first part,") and main_text(page).endswith("for long. one two x = 1")
    page = f"<body><div id=content><p><a href=1>Home</a></p><h2><a href=2>Title</a></h2>{part}<p class=end>Fin</p><p><a href=3>Next page</a></p></div></body>"
    assert main_text(page).startswith("Title The first part,") and main_text(page).endswith("for long. Fin")


def test_unclosed_elements_that_are_skipped():
    for name in ("svg", "select", "canvas", "audio", "video", "object", "noscript", "template"):
        for whole in ("", f"<{name} class='a>b'>gone<{name}>too</{name}></{name.upper()} >", f"<!-- </{name}> -->"):
            for before in ("", f"<{name}>no, no. No</{name}>"):
                page = f"<body>{before}<{name} x=1><article>{ARTICLE}{whole}<p>And, after it. All.</p></article></body>"
                assert main_text(page) == WANT + " And, after it. All.", page
    assert main_text(f"<article>{ARTICLE}<svg/><p>End, of it.</p></article><script>x = 1; <p>no, no. No</p>") == WANT + " End, of it."
    assert main_text(f"<article>{'<svg>' * 20000}{ARTICLE}</article>") == WANT


def test_formulas_and_sections_of_the_article_stay():
    long = "<p>A section with much to say, in words, and more words. It goes on, and on; then it ends, at last.</p>" * 3
    assert main_text("<article><p>Let <math><mi>x</mi></math> be, as said. Then more, of it.</p></article>") == "Let x be, as said. Then more, of it."
    for name in ("discussion", "responses", "notice", "tags", "related", "legal-history", "copyright-law"):
        page = f"<body><nav><a href=1>Menu</a></nav><article><h1>Title</h1>{long}<div class='{name}'>{long}</div>{long}</article><footer>Us, here.</footer></body>"
        assert main_text(page).count("at last.") == 9, name


def sentences(rng, n):
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(1, 9)))
    return " ".join(", ".join(" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(1, 4))).capitalize() + "." for _ in range(n))


def gold_page(rng, article, named):
    """A page and its article's text. named: classes say what they are, else they are random letters."""
    c = lambda name: name if named else "".join(rng.choice("qwxyz") for _ in range(6))
    parts, gold = [], []
    for k in range(rng.randrange(6, 25)):
        kind = rng.choice(["p", "p", "p", "p", "h2", "ul", "blockquote"]) if k else "h1"
        if kind == "ul":
            items = [sentences(rng, 1) for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            gold += items
        else:
            text = sentences(rng, rng.randrange(2, 8)) if kind in ("p", "blockquote") else sentences(rng, 1)[:40].strip()
            parts.append(f"<{kind}>{text}</{kind}>")
            gold.append(text)
    links = lambda n: "<ul>" + "".join(f"<li><a href={i}>{sentences(rng, 1)[:14].strip()}</a></li>" for i in range(n)) + "</ul>"
    body = f"<article>{''.join(parts)}</article>" if article else f"<div class={c('post')}><div class={c('body')}>{''.join(parts)}</div></div>"
    html = (
        f"<html><head><title>T</title><style>p{{x}}</style></head><body><div class={c('topbar')}>{links(6)}</div><div class={c('ad')}>Buy now.</div>"
        f"<div class={c('wrap')}>{body}<div class={c('sidebar')}><h3>More</h3>{links(8)}<div>Sign up today</div></div></div><div class={c('footer')}><span>Made here</span> <a href=x>Contact</a></div><script>var a = '<p>x, y. z</p>';</script></body></html>"
    )
    return html, " ".join(gold)


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize("named", [True, False])
def test_precision_and_recall_against_gold_texts(article, named):
    rng = random.Random(5 + article + 2 * named)
    both = found = wanted = 0
    for _ in range(120):
        html, gold = gold_page(rng, article, named)
        a, b = Counter(main_text(html).split()), Counter(gold.split())
        both, found, wanted = both + (a & b).total(), found + a.total(), wanted + b.total()
    assert both / found >= 0.99 and both / wanted >= 0.99, (both / found, both / wanted)


def test_scores_decide(monkeypatch):
    rng = random.Random(2)
    pages = [gold_page(rng, k % 2, k % 4 > 1)[0] for k in range(60)]
    texts = [main_text(p) for p in pages]

    def constant(some, elements):
        for b in some:
            b.score = 100.0

    monkeypatch.setattr(html_text, "scores", constant)
    assert sum(main_text(p) != t for p, t in zip(pages, texts, strict=True)) >= 50


def test_time_grows_with_length():
    for odd in ("<div>", "<a ", "</p>", "<ul><div><li>", "<h1>", "<script></script", "<svg ", "<a '", "<table><tr><td>"):
        began = time.process_time()
        main_text(f"<p>Some text, here. More of it.</p>{odd * 100_000}<p>Some text, here. More of it.</p>")
        assert time.process_time() - began < 5, odd
    began = time.process_time()
    main_text("<div>" * 100_000 + "<p>deep, text. here</p>" + "<li>" * 100_000 + "</p>" * 100_000)
    assert time.process_time() - began < 5


def test_rows(spark):
    rows = [(1, "u", "<article><p>One, two. Three é</p></article>", "x"), (1, "u", "<article><p>One, two. Three é</p></article>", "y"), (None, None, None, None), (2, "v", "", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(str, (tuple(r) for r in extract(frame).collect())))
    assert got == sorted(map(str, [(1, "u", "One, two. Three é", 17)] * 2 + [(None, None, "", 0), (2, "v", "", 0)]))
    assert extract(frame.limit(0)).count() == 0
