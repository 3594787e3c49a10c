"""Extraction of main text, and the minimum cut against brute force."""

import itertools
import random

from boreframe.llm.html_extract import content_score, edges_of, extract_pages, main_text, min_cut, read_blocks

STORY = ["The river rose again in the night, and nobody in the village slept much.",
         "By morning the lower fields were gone; only the tops of the fence posts showed.",
         "Short one.",
         "Three families moved to the school, where volunteers had already set up beds &amp; heaters."]
TEXT = "\n".join(s.replace("&amp;", "&") for s in STORY)
PARAGRAPHS = "".join(f"<p>{s}</p>" for s in STORY)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8)) + "</ul>"

FRAMES = [
    "<nav>{menu}</nav><article><h1>Flood</h1>{body}</article><footer>&copy; 2024 Paper</footer>",
    "<header><a href=/>Paper</a>{menu}</header><main><h1>Flood</h1>{body}</main><aside><p>Read also this other very "
    "long teaser, which is a sentence of its own.</p></aside>",
    "<div id=top-menu>{menu}</div><div class='page-with-sidebar'><div class=post-content><h1>Flood</h1>{body}</div>"
    "<div class=sidebar><p>Our newsletter reaches ten thousand readers, every single day.</p></div></div>",
    "<div class='cookie-notice'><p>We use cookies to make this site better. Please accept them now.</p></div>"
    "<article><header><h1>Flood</h1></header>{body}<div class='ad'>Buy this car today, it is really cheap.</div>"
    "<section id='comments'><article class=comment><p>I was there, and it was much worse than they say!</p></article>"
    "</section></article>",
    "<div class=login><form><label>Name</label><input><p>Enter your name, then your password.</p></form></div>"
    "<div>{menu}</div><div><h1>Flood</h1>{body}</div>",
    "<div role=navigation>{menu}</div><div role=main><h1>Flood</h1>{body}</div><div hidden><p>Hidden words, long "
    "enough to look like text.</p></div><div role=contentinfo><p>All rights reserved.</p></div>",
]


def test_frames_lose_everything_but_the_article():
    for f in FRAMES:
        page = "<!DOCTYPE html><html><head><title>Flood</title><style>p{}</style></head><body>" \
            + f.format(menu=MENU, body=PARAGRAPHS) \
            + "<script>var p='<p>no</p>';</script><!-- <p>no</p> --></body></html>"
        assert main_text(page) == "Flood\n" + TEXT, f


def test_blocks_decode_and_collapse():
    page = "<article><p>a &lt;b&gt; &#233;&eacute;\n\t x<b>y</b>z<br>next<p>unclosed <i>it<p>5 < 6 &amp;&amp; 7 > 2</article>"
    assert [b.text for b in read_blocks(page)] == ["a <b> éé xyz next", "unclosed it", "5 < 6 && 7 > 2"]
    assert main_text(page) == "a <b> éé xyz next\nunclosed it\n5 < 6 && 7 > 2"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<!-- open") == ""
    assert main_text("<script>if (a < b) {") == ""
    main_text("<p>" * 5000 + "x" + "</div>" * 5000 + "<a href='unclosed")
    long = " ".join(["word"] * 50_000)
    assert main_text(f"<article><p>{long}.</p></article>") == long + "."


def test_min_cut_is_minimal():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(1, 9)
        unary = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]

        def total(label):
            return sum(abs(u) for u, x in zip(unary, label) if (u > 0) != x) \
                + sum(c for a, b, c in edges if label[a] != label[b])
        best = min(total(x) for x in itertools.product([False, True], repeat=n))
        assert total(min_cut(unary, edges)) <= best + 1e-6


def test_weak_blocks_follow_their_neighbours():
    assert min_cut([2.0, -0.3, 2.0], [(0, 1, 0.9), (1, 2, 0.9)]) == [True, True, True]
    assert min_cut([-2.0, 0.3, -2.0], [(0, 1, 0.9), (1, 2, 0.9)]) == [False, False, False]


def test_the_cut_decides_where_a_block_alone_is_wrong():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(4)) \
        + "<li>Welcome to this site, dear reader.</li>" \
        + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(4)) + "</ul>"
    planted = {  # page without names: text that must stay and must go
        f"<div>{menu}</div><div><p>{STORY[0]}</p><div>3 May</div><p>{STORY[1]}</p></div>": "3 May",
        f"<div>{menu}</div><div><p>{STORY[0]}</p><p><a href=/x>See the map</a> here.</p><p>{STORY[1]}</p></div>":
            "See the map here.",
    }
    for page, kept in planted.items():
        blocks = read_blocks(page)
        costs = [content_score(b) for b in blocks]
        alone = {b.text: c > 0 for b, c in zip(blocks, costs)}
        cut = {b.text: x for b, x in zip(blocks, min_cut(costs, edges_of(blocks)))}
        assert alone["Welcome to this site, dear reader."] and not cut["Welcome to this site, dear reader."]
        assert not alone[kept] and cut[kept]
        assert main_text(page) == "\n".join([STORY[0], kept, STORY[1]])


def test_names_are_weighed_by_the_text_below():
    search = "<input type=hidden name=state><input name=q><button>Find</button>"
    long = PARAGRAPHS + f"<p>{STORY[1]}</p>" * 3
    text = TEXT + f"\n{STORY[1]}" * 3
    assert main_text(f"<form id=aspnetForm>{search}<nav>{MENU}</nav><h1>Flood</h1>{long}</form>") == "Flood\n" + text
    assert main_text(f"<form id=aspnetForm>{search}{long}</form>") == text
    assert main_text(f'<article class="post comments-open">{PARAGRAPHS}</article>') == TEXT
    assert main_text(f"<div class='widget'><h1>Flood</h1>{PARAGRAPHS}</div>") == "Flood\n" + TEXT
    for name in ("comments", "ad", "sidebar"):  # prose of that kind still goes, also where it is longer
        page = f"<article><h1>Flood</h1>{PARAGRAPHS}<div class={name}>{long}{long}</div></article>"
        assert main_text(page) == "Flood\n" + TEXT
    form = "<form><p>Our newsletter reaches ten thousand readers every day.</p><input><button>Join</button></form>"
    assert main_text(f"<article>{PARAGRAPHS}{form}</article>") == TEXT


def test_malformed_pages_keep_their_text():
    assert main_text("<p title=it's>One is here, they said.</p><p>This isn't lost, as they said.</p>") \
        == "One is here, they said.\nThis isn't lost, as they said."
    for tag in ("svg", "object", "select", "noscript", "template"):
        open_ = f"<article>{PARAGRAPHS}<{tag}><p>{STORY[1]}</p></article>"
        assert main_text(open_) == f"{TEXT}\n{STORY[1]}"
        assert main_text(f"{open_}<footer><{tag}>x</{tag}></footer>") == f"{TEXT}\n{STORY[1]}"
        assert main_text(f"<article>{PARAGRAPHS}<{tag}><p>no</p></{tag}></article>") == TEXT
    assert main_text(f"<article>{PARAGRAPHS}</article><script>var a;") == TEXT
    assert main_text(f"<article>{PARAGRAPHS}</article>" + "<a x='1' y=\"2\" " * 20_000).startswith(TEXT)
    assert [b.text for b in read_blocks("<p a='1>2' b=\"it's\">x</p><p>y")] == ["x", "y"]


def test_blocks_of_random_trees():
    rnd = random.Random(7)

    def grow(depth, out, parts):
        """Random element content as html; texts go to ``parts``, blocks to ``out``."""
        page = ""
        for _ in range(rnd.randint(0, 4)):
            kind = rnd.choice(["text", "inline", "block", "raw", "comment", "br"])
            if kind == "text":
                text = rnd.choice(["a", " b ", "c &amp; d", "\n", "é", "x  y"])
                parts.append(text.replace("&amp;", "&"))
                page += text
            elif kind == "br":
                parts.append(" ")
                page += "<br>"
            elif kind == "raw":
                page += rnd.choice(["<script>if (a<b) '<p>'</script>", "<style>p{}</style>"])
            elif kind == "comment":
                page += "<!-- <p>no</p> -->"
            elif depth and kind == "inline":
                page += f"<b class='x>y'>{grow(depth - 1, out, parts)}</b>"
            elif depth:
                flush(out, parts)
                inner = grow(depth - 1, out, parts)
                flush(out, parts)
                page += f"<div>{inner}</div>"
        return page

    def flush(out, parts):
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    for _ in range(300):
        out, parts = [], []
        page = grow(4, out, parts)
        flush(out, parts)
        assert [b.text for b in read_blocks(page)] == out, page


def test_pages_table(spark):
    rows = [(1, "u", FRAMES[0].format(menu=MENU, body=PARAGRAPHS), "x"), (2, None, None, "x"), (None, "u", "", "x"),
            (1, "u", FRAMES[0].format(menu=MENU, body=PARAGRAPHS), "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(d).collect())
    whole = "Flood\n" + TEXT
    assert got == [(0, "", 0), (1, whole, len(whole)), (1, whole, len(whole)), (2, "", 0)]
    assert extract_pages(d.limit(0)).count() == 0
