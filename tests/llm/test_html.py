"""Site templates against pages of known make and a naive count, names of classes, and deep pages."""

import random
import time
from collections import Counter, defaultdict

from lodestone.llm import html

SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows):
    return {x["page_id"]: x["text"] for x in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_names_of_classes():
    text = lambda h: "\n".join(html.parse(h)[0])
    assert text('<article class="post comments-open"><p>a</p></article>') == "a"
    assert text('<div id="search-results"><p>a</p></div>') == "a"
    assert text('<div class="widget"><p>a</p></div>') == "a"
    assert text('<div class="widget"><p>no</p></div><div><p>a</p></div>') == "a"
    assert text('<article><p>a</p></article><article class="comment"><p>no</p></article>') == "a"
    assert text('<main class="search main-content"><p>a</p></main>') == "a"
    assert text('<div class="comments-area"><p>no</p></div>') == ""
    assert text('<article><p>a</p><div class="article-comments"><p>no</p></div><div class="cookie-banner">no</div><div class="ad-slot">no</div></article>') == "a"
    assert text('<body class="with-sidebar no-comments"><p>a</p><div id="site-footer">no</div></body>') == "a"


def test_templates_of_sites_without_any_marks(spark):
    """Menus, boxes and footers that only recurrence tells from text: all of them go, and nothing else does."""
    r = random.Random(5)
    rows, want = [], {}
    for host in range(6):
        menu = "".join(f"<div><span>Menu {host} {k}</span></div>" for k in range(4))
        foot = f"<section><div>Owned by site {host}</div><div>All of it</div></section>"
        boxes = [f"<div><div>Box {host} {k}</div></div>" for k in range(3)]
        for i in range(30):
            own = [f"Story {host} {i} {k} {r.random()}" for k in range(r.randint(1, 5))]
            parts = [f"<div><div>{x}</div></div>" for x in own]
            parts.insert(r.randint(0, len(parts)), r.choice(boxes))
            page = host * 100 + i
            rows.append((page, f"http://Site{host}.example/{i}", f"<html><body><div>{menu}</div><div>{''.join(parts)}</div>{foot}</body></html>"))
            want[page] = "\n".join(own)
    rows += [(9000 + i, "http://few.example/", f"<div>Menu</div><div>Text {i}</div>") for i in range(4)]
    want |= {9000 + i: f"Menu\nText {i}" for i in range(4)}
    assert extracted(spark, rows) == want


def naive(rows):
    """Counts and deletes page by page, ancestor by ancestor."""
    pages = [(i, url.split("/")[2], *html.parse(h)) for i, url, h in rows]
    hosts, seen, gone = defaultdict(set), defaultdict(set), set()
    for _, host, lines, subtrees, _ in pages:
        hosts[host].add(tuple(lines))
        for n, running, *_ in subtrees:
            seen[host, n, running].add(tuple(lines))
    for (host, n, running), copies in seen.items():
        if len(copies) >= max(html.TEMPLATE_PAGES, (html.TEMPLATE_TEXT_SHARE if running else html.TEMPLATE_SHARE) * len(hosts[host])):
            gone.add((host, n, running))
    out = {}
    for i, host, lines, subtrees, article in pages:
        left = [x for k, x in enumerate(lines) if not any(a <= k < b and (host, n, r) in gone for n, r, a, b in subtrees)]
        out[i] = "\n".join(left if left or not article else lines)
    return out


def test_templates_equal_a_naive_count(spark):
    r = random.Random(6)
    words = ["stone", "river"]

    def tree(depth):
        tag = r.choice(("div", "section", "p", "ul", "span", "b", "blockquote"))
        inside = "".join(tree(depth - 1) if depth and r.random() < 0.5 else r.choice(words) for _ in range(r.randint(1, 3)))
        return f"<{tag}>{inside}</{tag}>"

    rows = []
    for i in range(150):
        inner = "".join(tree(3) for _ in range(4))
        rows.append((i, f"http://h{i % 4}.example/{i}", f"<body>{tree(1)}<article>{inner}</article></body>" if i % 3 else f"<body>{inner}</body>"))
    got = extracted(spark, rows)
    assert got == naive(rows)
    assert Counter(got[i] == "\n".join(html.parse(h)[0]) for i, _, h in rows)[False] > 10


def test_deep_and_long_pages(spark):
    began = time.perf_counter()
    deep = "".join(f"<div>line {i} " for i in range(40_000)) + "</div>" * 40_000
    rows = [(i, "http://deep.example/", deep.replace("line 7 ", f"line {i} ") if i else deep) for i in range(2)]
    got = extracted(spark, [*rows, (5, None, "<p>" + "long words " * 300_000 + "</p>")])
    assert got[0].count("\n") == 39_999 and got[5] == ("long words " * 300_000).strip()
    assert time.perf_counter() - began < 120


def test_equal_pages_keep_their_article(spark):
    page = "<body><nav>menu</nav><article><h1>Title</h1><p>Body of it.</p></article></body>"
    got = extracted(spark, [(i, "http://one.example/a", page) for i in range(6)])
    assert set(got.values()) == {"Title\nBody of it."}
