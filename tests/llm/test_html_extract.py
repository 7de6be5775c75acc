import re
from html.parser import HTMLParser

from quadrille.llm import html_extract as H
from quadrille.llm.html_extract import extract, extract_text

PROSE = "This is a sentence of the article that has the usual words in it, and it is long enough to be told from a menu by its length and by the words that are in it."


def test_article_only():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
    <header>Site name</header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- no <p>no</p> --><div class="ad">Buy this of the and</div>
    <aside><p>{PROSE} aside</p></aside>
    <article><h1>Head &amp; more</h1><p><b>{PROSE}<br>x&eacute;&#x4e;&nbsp;y<p>Short.</p><form><label>Mail</label></form><div class="notice">{PROSE} notice</div>
    <ul><li>one of</li><li>two</li></ul><section id="comments"><p>{PROSE} comment</p></section><p>Last</p></article>
    <div class="sidebar">{PROSE}</div><footer>&copy; me</footer></body></html>"""
    assert extract(page) == f"Head & more\n{PROSE} xéN y\nShort.\none of\ntwo\nLast"


def test_without_article():
    links = "".join(f"<li><a href='{k}'>link number {k}</a></li>" for k in range(9))
    page = f"<body><ul>{links}</ul><p>Intro</p><p>{PROSE}</p><p>Mid</p><p>{PROSE}</p><div><a href=x>{PROSE}</a></div>"
    assert extract(page) == f"Intro\n{PROSE}\nMid\n{PROSE}"


def test_broken_and_edge():
    assert extract(None) == extract("") == extract("<html><body></body>") == ""
    assert extract("<article><p>a<p>b &lt;c&gt; <i>d") == "a\nb <c> d"
    assert extract("<article>x<script>never closed <p>y") == "x"
    assert extract(f'<article><p title="a>b">{PROSE}</p><p hidden>no</p></article>') == PROSE


def test_density_decides_beside_sections_too():
    assert extract(f"<main><p>{PROSE}</p></main><div><p>more {PROSE}</p></div><div>Share this</div>") == f"{PROSE}\nmore {PROSE}"
    assert extract(f"<main><p>{PROSE}</p><p>short</p></main><div><p>beside</p></div>") == f"{PROSE}\nshort"
    links = " ".join(f"<a href='{k}'>this is a link to the page that is number {k} of the site</a>" for k in range(9))
    assert extract(f"<article><p>{PROSE}</p><p>{links}</p><p>mid</p><p>{PROSE}</p><p>end</p></article>") == f"{PROSE}\nmid\n{PROSE}\nend"


def test_hidden_and_named_inline_elements_go():
    page = f'<article><p>{PROSE} x <span hidden>secret <span>more</span> of it</span> y <span class="advert">Buy</span> z</p><p>a <b style="display: none">b</p><p>c</p></article>'
    assert extract(page) == f"{PROSE} x y z\na\nc"


def test_pages_without_prose():
    table = " | ".join(f"wort{k}" for k in range(30))
    assert extract(f"<body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{table}</p><p>end</p></article><div>beside</div>") == f"Head\n{table}\nend"
    assert extract("<article><h1>One</h1><p>two</p></article><div>three</div>") == "One\ntwo" and extract("<div>one</div><p>two") == "one\ntwo"


def test_very_long_and_repeated_blocks():
    page = "<article>" + f"<p>{PROSE}</p><p>tie</p>" * 4000 + "</article>"
    assert extract(page) == "\n".join([PROSE, "tie"] * 4000)
    assert len(extract(f"<p>{PROSE * 20000}</p>")) == len(PROSE) * 20000


class Plain(HTMLParser):
    """A second version for well-formed pages: the blocks by the standard parser."""

    def __init__(self, page):
        super().__init__()
        self.path, self.blocks, self.open, self.n, self.skip, self.link = [], [], [], 0, 0, False
        self.feed(page)
        self.flush()

    def flush(self):
        text = " ".join("".join(t for t, _ in self.open).split())
        if text and not any(n in H.APART or called for n, called, _ in self.path):
            self.blocks.append((text, sum(len(t.strip()) for t, linked in self.open if linked), [k for n, _, k in self.path if n not in H.ROOT], any(n in H.SECTION for n, *_ in self.path)))
        self.open = []

    def handle_starttag(self, tag, attrs):
        if tag in H.RAW and tag != "head" or tag == "title":
            self.skip += 1
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self.open.append((" ", False))
        elif tag in H.BLOCK:
            self.flush()
            if tag == "p" and self.path and self.path[-1][0] == "p":
                self.path.pop()
            self.n += 1
            self.path.append((tag, dict(attrs).get("class") == "ad", self.n))

    def handle_endtag(self, tag):
        if tag in H.RAW and tag != "head" or tag == "title":
            self.skip -= 1
        elif tag == "a":
            self.link = False
        elif tag in H.BLOCK:
            self.flush()
            if tag in [n for n, *_ in self.path]:
                while self.path.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.skip:
            self.open.append((data, self.link))

    def text(self):
        def label(text, linked):
            if linked > 0.34 * len(text) and len(text) - linked < 140:
                return False
            words = re.findall(r"[^\W\d_]+", text)
            share = sum(w.lower() in H.STOP_WORDS for w in words) / max(1, len(words))
            return True if len(text) >= 140 and share >= 0.15 or len(text) >= 50 and share >= 0.3 else None

        labels = [label(t, linked) for t, linked, *_ in self.blocks]
        if True not in labels:
            labels = [True if x is None and len(b[0]) >= 140 else x for x, b in zip(labels, self.blocks)]
        kept = []
        for k, (text, _, path, section) in enumerate(self.blocks):
            own = labels[k]
            if own is None and True not in labels:
                own = section or not any(b[3] for b in self.blocks)
            elif own is None:
                near = []
                for way in (range(k - 1, -1, -1), range(k + 1, len(labels))):
                    j = next((j for j in way if labels[j] is not None and self.blocks[j][3] == section), None)
                    if j is not None:
                        near.append((len(set(path) ^ set(self.blocks[j][2])), abs(j - k), not labels[j]))
                if near and not section:
                    near.append((len(path) + 1, 10**9, True))
                own = not min(near)[2] if near else section or not any(b[3] and x for b, x in zip(self.blocks, labels))
            if own:
                kept.append(text)
        return "\n".join(kept)


def without_tags(page):
    """Sections, navigation and footers as mere divisions."""
    return re.sub(r"<(/?)(?:article|main|nav|footer)\b[^>]*>", r"<\1div>", page)


def test_pages_of_the_table_against_a_second_version(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert len(pages) == 250
    for page in pages:
        want = Plain(page).text()
        assert extract(page) == want
        assert extract(without_tags(page)) == Plain(without_tags(page)).text()
    same = [extract(without_tags(p)) == extract(p) for p in pages]
    assert sum(same) >= 0.75 * len(same)  # without such elements densities and neighbours alone find the text of most


def test_table(spark):
    rows = [(1, "u", None), (2, None, "<article><p>é</article>"), (2, None, "<article><p>é</article>"), (None, "v", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in extract_text(df).collect()]
    assert got == [(1, "u", "", 0), (2, None, "é", 1), (2, None, "é", 1), (None, "v", "", 0)]
    assert extract_text(df.where("false")).count() == 0
