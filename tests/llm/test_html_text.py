import random
import re
import time
from html import unescape
from math import e, log

from matchweave.llm.html_text import Page, composite_density, extract, main_text


def test_known_template(spark):
    """The synthetic pages hold one article element; its blocks are the main text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", html[r.page_id], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in blocks]
        assert r.text == "\n".join(w for w in want if w)
        assert r.n_chars == len(r.text)


def test_boilerplate_without_article_element():
    para = "This is a long paragraph of the story, with plenty of words in it, and no link at all. " * 3
    html = (
        "<html><head><title>T</title></head><body class='has-sidebar'><div id=top-menu><a href=a>Home</a> <a href=b>News</a></div>"
        "<header><h2>Site</h2></header><div class='wrap'><div class=content><h1>Head &amp; line</h1>"
        f"<p>{para}<p>{para}<div class='cookieNotice'>We use cookies</div><ul><li>one<li>two &lt;b&gt;</ul><p>{para}</div></div>"
        f"<div class='comments'><p>{para}</div><aside>{para}</aside><form><p>Name<input></form><footer>c</footer><script>x='<p>'</script>"
    )
    p = para.strip()
    assert main_text(html) == "\n".join(["Head & line", p, p, "one", "two <b>", p])


def test_attributes_are_read_by_their_names(spark):
    """Style values, data attributes and remarks about the layout take nothing from the template's pages."""
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    whole = [main_text(h) for h in pages]
    for attribute in ('style="overflow:hidden"', 'data-id="share"', 'data-class="ad" data-role=menu', 'class="has-sidebar no-ads"', 'class="social-policy"', "title='hidden class=ad'"):
        assert [main_text(re.sub(r"<p\b", f"<p {attribute}", h)) for h in pages] == whole


def test_marks_that_hold_the_page_stay():
    para = "A sentence of the story that goes on for a while without any link. " * 6
    p = para.strip()
    assert main_text(f'<body><form id="aspnetForm"><input type=hidden name=v><div><p>{para}<p>{para}</div></form>') == f"{p}\n{p}"
    assert main_text(f'<body><div class="layout has-sidebar"><p>{para}<p>{para}</div>') == f"{p}\n{p}"
    assert main_text(f'<body><div class="page menu"><div><p>{para}<p>{para}</div></div><div class=menu>few words</div>') == f"{p}\n{p}"
    assert main_text(f'<article><h1>T</h1><p>{para}</p><section class="social-policy"><p>{para}</p></section></article>') == f"T\n{p}\n{p}"
    boxes = "".join(f"<div class='{c}'><p>Short words beside the story.</div>" for c in ("cookie-notice", "top-menu", "siteFooter", "sidebar-left", "ad", "newsletter-box", "related-links"))
    form = "<form><label>Your name</label><input><textarea></textarea><button>Send</button></form>"
    assert main_text(f"<body>{boxes}<div><p>{para}<p>{para}</div>{form}<div style='display: none'>{para * 9}</div>") == f"{p}\n{p}"
    assert main_text(f"<body><div><p>{para}<p>{para}</div><div class='comments'><p>{para * 9}</div><div id=comment-list><p>{para * 9}</div>") == f"{p}\n{p}"


def test_link_lists_lose_to_text():
    links = "".join(f"<li><a href='/{k}'>A linked headline number {k}</a></li>" for k in range(40))
    text = "Plain sentence with several words in a row. " * 8
    got = main_text(f"<body><div><ul>{links}</ul></div><div><p>{text}</p><p>{text}</p></div></body>")
    assert got == "\n".join([text.strip()] * 2)


def test_odd_input(spark):
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<!-- x") == ""
    assert main_text("just text") == "just text"
    assert main_text("a < b &amp") == "a < b &"
    assert main_text("<article><p>cut <b>off</b> here <a hre") == "cut off here"
    assert main_text("<p>x<br>y  \n z</p>") == "x y z"
    assert main_text('<article><p title="a>b">t</p></article>') == "t"
    deep = main_text("<div>" * 30_000 + "deep text" + "</div>" * 30_000)
    assert deep == "deep text"
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x", 1), (None, "u", "<p>a", "x", 1), (None, "u", "<p>a", "x", 1)]
    assert sorted((r.page_id or 0, r.text) for r in extract(spark.createDataFrame(rows, schema)).collect()) == [(0, "a"), (0, "a"), (1, "")]


def test_density_alone_finds_the_same_text(spark):
    """With article and main renamed to div, heading and body are chosen by density."""
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", h) for h in pages]
    assert pages != plain and [main_text(h) for h in plain] == [main_text(h) for h in pages]


def test_density_equals_brute_force():
    rng = random.Random(3)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return (rng.choice(["div", "p", "a", "b", "section"]), "w" * rng.randrange(30), kids)

    def show(node):
        tag, text, kids = node
        return f"<{tag}>{text}{''.join(map(show, kids))}</{tag}>"

    def sums(node, inside):
        tag, text, kids = node
        inside = inside or tag == "a"
        c, t, lc, lt = len(text), 0, len(text) * inside, 0
        for kid in kids:
            kc, kt, klc, klt = sums(kid, inside)
            c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (kid[0] == "a")
        return c, t, lc, lt

    checked = 0
    while checked < 30:
        root = ("div", "x" * 9, [tree(3) for _ in range(3)])
        page = Page(show(root))
        if page.tags[1:] != re.findall(r"<([a-z]+)>", show(root)) or "</" not in show(root):
            continue
        nodes, stack = [], [(root, False)]
        while stack:
            node, inside = stack.pop()
            nodes.append(sums(node, inside))
            stack += [(kid, inside or node[0] == "a") for kid in reversed(node[2])]
        parents = page.parents[2:]
        flat, todo = [], [(root, -1)]
        while todo:
            node, up = todo.pop()
            flat.append(up)
            todo += [(kid, len(flat)) for kid in reversed(node[2])]
        if parents != [x for x in flat[1:]]:
            continue  # the markup closed something on its own, such as a p before a div
        c, _, lc, _ = nodes[0]
        share, want = lc / c, []
        for c, t, lc, lt in nodes:
            t = max(t, 1)
            base = log(log(c / max(c - lc, 1) * lc + share * c + e) + e - 1)
            want.append(c / t * log(max(c / max(lc, 1) * t / max(lt, 1), 1) + 1) / base if c else 0.0)
        got = composite_density(page, [False] * len(page.tags))[1:]
        assert all(abs(x - y) < 1e-9 for x, y in zip(got, want, strict=True))
        checked += 1


def test_deep_unclosed_markup_is_linear():
    began = time.time()
    assert main_text("<p><b>" * 20_000 + "<i>x</i>" * 20_000 + "<p>end") == "x" * 20_000 + "\nend"
    assert time.time() - began < 20
