import random
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from tidewater.llm.html_extraction import Page, extract, tags


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>one</p><p>two", "one\n\ntwo"),
        ("<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; &eacute;</h1><p><b>a  b<br>c\n d</b><p>e<script>var t='</p>'</script></article><footer>f</footer>", "T & é\n\na b c d\n\ne"),
        ("<body><div class='ad'>buy</div><div class='content'><p>long text here, enough of it.</p><div class=comments><p>nice!</p></div></div></body>", "long text here, enough of it."),
        ("<main><p>kept<!-- no <p>--> on</p><form><input value=1>x</form><aside>y</aside></main>", "kept on"),
        ("<article><header>h</header><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article>", "1\n\n2\n\na\n\nb"),
        ("plain text", "plain text"),
        ("<p>a < b</p><p title='x > y'>c", "a < b\n\nc"),
        ("<style>p{}</style><title>t</title>", ""),
        ("<div style='display: none'>no</div><p>yes<span class='ad'>no</span>", "yes"),
        ("<p>in<b>li</b>ne <a href=#>link</a></p>", "inline link"),
    ],
)
def test_page(source, text):
    assert Page(source).extract(None) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p>a <i class=icon aria-hidden=true></i> b</p><p>c</p><p>d</p></article>", "a b\n\nc\n\nd"),
        ("<article><p>a <span class=ad>buy <span>it</span> now</span> b <em class=share>s</em>c</p><p>d</article>", "a b c\n\nd"),
        ("<article><time class=header-date>May</time><p>a</p><div>b<span class=ad>x</span></div>c</article>", "a\n\nb\n\nc"),
        ("<article><p>a <span class=ad>left open</p><p>b<p>c</article>", "a\n\nb\n\nc"),
        ("<article><p><span>a <span class=ad>x</span> b</span> c</p></article>", "a b c"),
    ],
)
def test_text_after_a_skipped_inline_element(source, text):
    assert Page(source).extract(None) == text


def test_hosts_agree(spark):
    good = "<div class='box-{0}'><p>{1}</p><p>{1}</p></div>"
    pages = [(i, f"http://Example.com:80/{i}", f"<body><div class='x{i}'>" + good.format(i, "some prose that is long " * 5) + "</div><div class='extra'>" + ("side talk " * {3: 30, 4: 60}.get(i, 2)) + "</div></body>") for i in range(9)]
    got = {r.page_id: r for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len({r.path for r in got.values()}) == 1 and {r.host for r in got.values()} == {"example.com"}
    # pages 3 and 4 alone would take the talk
    alone = [i for i, _, source in pages if "side talk" in Page(source).extract(None)]
    assert alone == [3, 4] and not [i for i, r in got.items() if "side talk" in r.text]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_consensus_is_by_host(spark):
    """Two hosts with templates of their own; on each, some pages have more of something else than of their article."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choices("tide water shore light boat wind rope sand".split(), k=n))
    pages, want = [], {}
    for i in range(24):
        own, other = prose(12 if i % 5 == 4 else 120), prose(90 if i % 5 == 4 else 10)
        if i % 2:
            source = f"<body><div class=wrap><div class='story s{i}'><p>{own}</p></div></div><div class=box><p>{other}</p></div></body>"
        else:
            source = f"<body><table><tr><td class=left><p>{other}</p></td><td class=text><p>{own}</p></td></tr></table></body>"
        pages.append((i, f"https://{'ab'[i % 2]}.org/{i}", source))
        want[i] = own
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
    alone = {i: Page(source).extract(None) for i, _, source in pages}
    assert [i for i in alone if alone[i] != want[i]] == [4, 9, 14, 19]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<body><form id=aspnet><div class=content><h1>T</h1><p>a b</p><input name=x><select><option>o</select><button>go</button></div></form></body>", "T\n\na b"),
        ("<body><form><p>all of the text there is</p><label>name</label></form></body>", "all of the text there is\n\nname"),
        ("<article><p>one two three</p><form><p>join our list</p></form><p>four</p></article>", "one two three\n\nfour"),
        ("<body><form class=search><p>find things</p></form><p>hi</p></body>", "hi"),
    ],
)
def test_forms(source, text):
    assert Page(source).extract(None) == text


@pytest.mark.parametrize("unit", ['<a b="x ', "<i x ", '<div class="a b1">', "<div>x", "<h1>x", "<p>x", "<!-- a ", "<script>x", '<a "<b>" ', "<", "<span class=ad>", "<td>x", "</p>", "<form>", "&amp;<b"])
def test_time_and_memory_grow_with_the_page(unit):
    """Of anything left open: twice the page, about twice the time."""

    def seconds(n):
        source = unit * (n // len(unit)) + "'"
        began = time.process_time()
        Page(source).extract(None)
        return time.process_time() - began

    assert seconds(1 << 18) < 3 * seconds(1 << 17) + 0.3
    tracemalloc.start()
    seconds(1 << 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20


class Second(HTMLParser):
    """Another reader: the text of each block that is not within what is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.buffer, self.off = [], [], []

    def cut(self):
        if text := " ".join("".join(self.buffer).split()):
            self.out.append(text)
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        if tag in ("nav", "footer", "script", "style") or dict(attrs).get("class") == "ad":
            self.off.append(tag)
        if tag in ("div", "p", "ul", "li", "article", "nav", "footer", "h2"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("div", "p", "ul", "li", "article", "nav", "footer", "h2"):
            self.cut()
        if self.off and self.off[-1] == tag:
            self.off.pop()

    def handle_data(self, data):
        if not self.off:
            self.buffer.append(data)


@pytest.mark.parametrize("seed", range(40))
def test_same_text_as_another_parser(seed):
    """Well-formed pages of one article."""
    rng = random.Random(seed)

    def inline():
        kind = rng.randrange(8)
        word = rng.choice(["a", "b &lt; c", "d&eacute;", "e\n f", "&#x41;g", "&nbsp;h", "i > j"])
        return {0: f"<b>{word}</b>", 1: f"<a href='x>y'>{word}</a>", 2: f"<!-- <p> {word} -->", 3: f"<script>var a = '<p>{word}</p>';</script>", 4: f"<img alt='{word}'>"}.get(kind, word + " ")

    def block(depth):
        kind = rng.choice(["p", "p", "h2", "ul", "div", "nav", "ad"] if depth < 4 else ["p"])
        inner = lambda n: "".join(block(depth + 1) for _ in range(n)) if depth < 4 else ""
        texts = "".join(inline() for _ in range(rng.randint(0, 5)))
        return {
            "p": f"<p id=x{depth}>{texts}</p>", "h2": f"<h2>{texts}</h2>", "ul": f"<ul><li>{texts}</li><li>{inner(1)}</li></ul>", "div": f"<div>{inner(rng.randint(0, 3))}</div>",
            "nav": f"<nav>{texts}</nav>", "ad": f"<div class='ad'>{texts}</div>",
        }[kind]

    source = "<article>" + "".join(block(0) for _ in range(6)) + "</article>"
    second = Second()
    second.feed(source)
    second.close()
    second.cut()
    assert Page(source).extract(None) == "\n\n".join(second.out)


def test_tags():
    source = "<p a='>' b=\">\"><!-- <x> --><br/></P ><!doctype x><b \"> c <1>"
    assert [(source[a:z], name, closes) for a, z, name, closes, _ in tags(source)] == [
        ("<p a='>' b=\">\">", "p", False), ("<!-- <x> -->", "", False), ("<br/>", "br", False), ("</P >", "p", True), ("<!doctype x>", "", False), ("<b \">", "b", False),
    ]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://h/", ""), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (None, "no host", "<p>" + "w " * 200_000), (5, "http://h/5", "<<<>>> &#0; &bogus; <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS text")
    got = extract(df).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[3].text == "x" and by[None].n_chars == 399_999
    assert extract(df.limit(0)).collect() == []
