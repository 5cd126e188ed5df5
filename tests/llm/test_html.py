from __future__ import annotations

import pytest

from echotide.llm import html_extraction
from echotide.llm.html_extraction import Page, main_text, valid_classes

PAGES = "page_id bigint, url string, html string, template string, of string"


def page(host: str, k: int, body: str, end: str = "</article><footer>&copy; site</footer></body></html>"):
    nav = "".join(f'<li><a href="/{k}{j}">menu {k} {j}</a></li>' for j in range(3))
    head = f'<!DOCTYPE html><html><head><title>T {k}</title><style>p{{x}}</style><script>var a="</p><article>";</script></head>'
    return f'{head}<body><nav><ul>{nav}</ul></nav><!-- <p>no</p> --><div class="ad">Buy {k}</div><article>{body}{end}'


CASES = [
    ("<h1>One</h1><p>a &amp; b&nbsp;c<p>d <b>e</b>f<br>g</p>", "One\na & b c\nd ef g"),
    ("<p>x</p><aside>side</aside><p>y <form>field</form>z</p>", "x\ny\nz"),
    ("<header><h1>Head</h1></header><ul><li>1<li>2</ul><div class='comments'>bad <p>bad</p></div>", "Head\n1\n2"),
    ("<p></p><p>  \n </p>", ""),
    ("<p>cut off &am", "cut off &am"),
    ('<div id="sidebar-left">no</div><div class="adder">yes</div><noscript><p>no</p></noscript>', "yes"),
]


@pytest.mark.parametrize("body, text", CASES)
def test_one_page(body, text):
    assert main_text(Page(page("h", 1, body))) == text
    assert main_text(Page(page("h", 1, body, end="<foot"))) == text


def test_classes_nest_or_go():
    assert set(valid_classes({1: [10, 11], 2: [20, 21]}, [10, 20, 21, 11])) == {1, 2}
    assert set(valid_classes({1: [10, 11], 2: [20, 21]}, [10, 20, 11, 21])) == {1}
    assert set(valid_classes({1: [10, 11]}, [11, 10])) == set()
    assert valid_classes({1: [10, 11]}, [10, 11, 10, 11]) == {1: [[0, 1], [2, 3]]}


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"http://big.example/{k}", page("big", k, *CASES[k % 6][:1])) for k in range(40)]
    out += [(100 + k, "https://copies.example/", page("copies", 1, CASES[0][0])) for k in range(8)]
    plain = "<body><div>Welcome to the site</div><div><p>Story {0}</p><p>More {0}</p></div><div>Contact us</div></body>"
    out += [(200 + k, f"http://plain.example/{k}", plain.format(k)) for k in range(6)]
    out += [(300, None, None), (301, "not a url", ""), (302, "http://[bad", page("x", 1, "<p>alone</p>")), (None, None, "<p>n</p>")]
    return out + [out[0]]


@pytest.mark.parametrize("broadcast_tokens", [200_000, 0])
def test_table(spark, rows, broadcast_tokens):
    table = spark.createDataFrame([(*r, None, "x") for r in rows], PAGES).repartition(3)
    got = html_extraction.extract(table, broadcast_tokens=broadcast_tokens).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(40):
        assert by[k].text == CASES[k % 6][1]
    assert all(by[100 + k].text == CASES[0][1] for k in range(8))
    # without an article, text that all pages of the host share is template
    assert all(by[200 + k].text == f"Story {k}\nMore {k}" for k in range(6))
    assert (by[300].text, by[301].text, by[302].text, by[None].text) == ("", "", "alone", "n")
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty(spark):
    assert html_extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("url", ["http://small.example/{}", None])
def test_copies_without_an_article_keep_their_text(spark, url):
    plain = "<body><div>Welcome</div><div><p>Story {0}</p><p>More {0}</p></div><div>Contact us</div></body>"
    held = [(k, plain.format("copied" if k < 6 else k)) for k in range(10)]
    table = spark.createDataFrame([(k, url and url.format(k), h, None, "x") for k, h in held], PAGES).repartition(3)
    got = {r.page_id: r.text for r in html_extraction.extract(table).collect()}
    assert got == {k: "Story {0}\nMore {0}".format("copied" if k < 6 else k) for k, _ in held}


WRAPPED = [
    ("<div class='layout with-sidebar'><article><p>x</p></article></div>", "x"),
    ("<div class='no-sidebar'><main><p>x</p></main></div>", "x"),
    ("<div class='sidebar'><article><p>x</p></article></div>", "x"),
    ("<article><h2 id='related-work'>R</h2><section id='side-effects'>s</section><p id='search-methods'>m</p></article>", "R\ns\nm"),
    ("<article><p class='alert'>a</p><h2 class='menu'>h</h2><div class='menu'>no</div></article>", "a\nh"),
    ("<article><p>x</p></article><div class='comments'><article>c</article></div><aside><article>n</article></aside>", "x"),
]


@pytest.mark.parametrize("body, text", WRAPPED)
def test_marks_drop_no_article_text(body, text):
    assert main_text(Page(f"<body>{body}</body>")) == text


NAMES = [
    ("<article><p>x</p><div class='social-science'>a</div><div class='search-results'>b</div>"
     "<p class='side-effects'>c</p><section id='comment-on-law'>d</section></article>", "x\na\nb\nc\nd"),
    ("<form id='all'><article><p>x</p><form>no</form></article></form>", "x"),
    ("<main><p>x</p><div class='ad'>no</div><section id='comments'><article>no</article></section></main>", "x"),
]


@pytest.mark.parametrize("body, text", NAMES)
def test_longer_names_stay(body, text):
    assert main_text(Page(f"<body>{body}</body>")) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<div>" * 100_000 + "x", "x"),
        ("<ul><li>" * 50_000 + "x" + "</b></li></ul>" * 50_000, "x"),
        ("<li><ul>" + "<div>" * 50_000 + "<li>x" * 50_000, "\n".join("x" * 50_000)),
        ("<p>" + "word " * 200_000 + "</p>", " ".join(["word"] * 200_000)),
    ],
)
def test_deep_and_long_pages(source, text):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.time()
    assert main_text(Page(source)) == text
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and time.time() - began < 60
    tracemalloc.stop()


def furnished(k: int, story: list[str], *, article: bool = True) -> str:
    """A page whose furniture only its repetition gives away."""
    share, teasers = "<p>Tell your friends about this story</p>", "".join(f"<article><p>Teaser {k} {j}</p></article>" for j in range(2))
    links = "<div>" + "".join(f'<a href="/{k}{j}">See also {k} {j}</a> ' for j in range(3)) + "</div>"
    body = "".join(f"<p>{s}</p>" for s in story)
    if not article:
        return f"<html><body><div><p>The Daily Page</p></div><section>{body}</section><div><p>All rights reserved</p></div></body></html>"
    return f"<html><body><p>Welcome</p>{teasers}<main><h1>T {k}</h1>{share}{body}{links}</main></body></html>"


@pytest.fixture(scope="module")
def hosts(spark):
    held, want = [], {}
    for k in range(12):
        story = [f"Paragraph {k} {j} of a story that only this page tells." for j in range(6)]
        held.append((k, f"http://news.example/{k}", furnished(k, story)))
        want[k] = "\n".join([f"T {k}", *story])
        held.append((100 + k, f"http://plain.example/{k}", furnished(k, story, article=False)))
        want[100 + k] = "\n".join(story)
        shared = [f"What all these near copies say, in part {j}, is their article." for j in range(6)]
        held.append((200 + k, f"http://mirror.example/{k}", f"<html><body><article>{''.join(f'<p>{s}</p>' for s in shared)}<p>no. {k}</p></article></body></html>"))
        want[200 + k] = "\n".join([*shared, f"no. {k}"])
    return spark.createDataFrame([(i, u, h, None, "x") for i, u, h in held], PAGES).repartition(3), held, want


def test_the_template_decides(hosts):
    table, held, want = hosts
    got = {r.page_id: r.text for r in html_extraction.extract(table).collect()}
    assert got == want
    alone = {i: main_text(Page(h)) for i, _, h in held}
    assert all(alone[i] != want[i] for i in want if i < 200)  # without deduction all furniture stays
    assert all("Teaser" in alone[i] and "Tell your" in alone[i] and "See also" in alone[i] for i in range(12))


def test_classes_equal_brute_force(hosts):
    """Classes by sums of hashes are those of whole occurrence vectors."""
    from collections import Counter, defaultdict

    table, held, _ = hosts
    pages = {"news": [], "plain": [], "mirror": []}
    for _, u, h in held:
        pages[u[7:].split(".")[0]].append(Counter(r for r, _, _ in Page(h).units))
    want = {}
    for name, counts in pages.items():
        vectors = defaultdict(set)
        for role in set().union(*counts):
            vector = tuple(c[role] for c in counts)
            if sum(x > 0 for x in vector) >= max(3, len(counts) / 2):
                vectors[vector].add(role)
        want[html_extraction.host_key(f"http://{name}.example/")] = {frozenset(c) for c in vectors.values() if len(c) >= 2}
    got = {}
    for r in html_extraction.deduce(table).collect():
        got[r["host"]] = {frozenset(c) for c in html_extraction.Template(r["template"]).classes.values()}
    assert got == want
