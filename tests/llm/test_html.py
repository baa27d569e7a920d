import time
from html.parser import HTMLParser

import pyarrow.parquet as pq

from topicwright.llm.html_text import blocks, classify, extract_text, main_text

STOPS = "The man that was in the house is one of those who have been there for all of this time and it was not his own. "


def test_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=/>Home</a></nav>
    <header><h1>Site</h1></header><div class="ad">Buy</div><article><header>by me <h2>Sub</h2></header><h1>Head&nbsp;line</h1><p><b>Short.<br><p>a &amp; b
    c <i>d</i>e&lt;f<!-- <p>gone</p> --></p><div id="share-bar">tweet</div><form><p>name</p></form><ul><li>x<li>y</ul><section class="comments"><p>me too</p></section>
    <aside>see</aside><div class="leading">kept</div><textarea>no</textarea></article><footer>&copy; x</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Sub", "Head line", "Short.", "a & b c de<f", "x", "y", "kept"]


def test_cut_off_and_odd_markup():
    assert main_text("<article><p>one</p><p>two &am") == "one\n\ntwo &am"
    assert main_text("<article><p>one<p class='x") == "one"
    assert main_text("<article>1 < 2 <3</article>") == "1 < 2 <3"
    assert main_text("<article><p>a</div></span>b</p><script>x") == "a\n\nb"
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<main><p>m</p></main><p>" + STOPS * 3) == "m"
    assert main_text("<article><p>long one</p><article><p>reader</p></article></article>") == "long one"
    assert main_text("<article hidden><p>no</p></article><article><p>yes</p></article>") == "yes"


def test_several_articles():
    assert main_text("<article><p>part one</p></article><p>between</p><article><p>second part</p></article>") == "part one\n\nsecond part"
    long = "<article class='comment reply'><p>" + STOPS * 5 + "</p></article>"
    assert main_text("<article class='post'><p>short</p></article>" + long) == "short"
    assert main_text("<article style='display:none'><p>never shown</p></article><article><p>yes</p></article>") == "yes"
    assert main_text(long) == (STOPS * 5).strip()
    assert main_text("<p>" + STOPS * 3 + "</p>" + long) == (STOPS * 3).strip()


def test_two_passes():
    long = STOPS * 3
    page = f"<div><p>Menu</p></div><div><a href=x>link one</a> <a>link two</a></div><h1>Title</h1><p>{long}</p><p>Short line.</p><p>{long}</p><p>{'Zxq ' * 60}</p><p>Tail</p><p>Copyright 2020</p>"
    assert main_text(page).split("\n\n") == ["Title", long.strip(), "Short line.", long.strip()]
    labels = [b.label for b in classify(blocks(page))]
    assert labels.count("good") == 4


class Plain(HTMLParser):
    """The text of an article by the library's parser, a paragraph at a time, for pages without odd markup in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.text, self.found = False, "", []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = True
        if tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = False

    def flush(self):
        if self.inside and self.text.split():
            self.found.append(" ".join(self.text.split()))
        self.text = ""

    def handle_data(self, data):
        self.text += data


def test_pages_against_the_librarys_parser():
    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist():
        plain = Plain()
        plain.feed(page or "")
        assert main_text(page) == "\n\n".join(plain.found)


def slow_labels(found):
    """The rules of classify(), block by block, as its text tells them."""
    import re

    from topicwright.llm.html_text import STOP_WORDS

    marked = any(b.article > 0 for b in found)

    def alone(b):
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        stops = len([w for w in words if w in STOP_WORDS]) / (len(words) or 1)
        full = b.link_chars > 0.2 * len(b.text)
        if b.article > 0:
            return "good" if not full and (len(b.text) > 200 or len(b.text) >= 70 and stops >= 0.3) else "open"
        if b.article < 0 or full or b.text.lower().startswith(("©", "(c)", "copyright ")):
            return "bad"
        if marked:
            return "near" if len(b.text) > 200 and stops >= 0.32 else "bad"
        if len(b.text) < 70:
            return "open" if not b.link_chars else "bad"
        return ("good" if len(b.text) > 200 else "near") if stops >= 0.32 else ("near" if stops >= 0.3 else "bad")

    first = [alone(b) for b in found]

    def nearest(labels, ok):
        return next((x for x in labels if x in ok), "bad")

    out = []
    for k, b in enumerate(found):
        left, right = nearest(first[:k][::-1], ("good", "bad")), nearest(first[k + 1 :], ("good", "bad"))
        if b.article > 0:
            own = [first[j] for j, x in enumerate(found) if x.article == b.article]
            others = any(first[j] == "good" for j, x in enumerate(found) if x.article > 0)
            links = any(x.link_chars for x in found if x.article == b.article)
            out.append("good" if "good" in own or not others or not links or left == right == "good" else "bad")
        elif first[k] == "near":
            out.append("good" if left == right == "good" or not marked and "good" in (left, right) else "bad")
        elif first[k] == "open":
            some = ("good", "bad", "near")
            sides = [nearest(first[k + 1 :], some)] if b.heading else [nearest(first[:k][::-1], some), nearest(first[k + 1 :], some)]
            out.append("good" if "bad" not in sides else "bad")
        else:
            out.append(first[k])
    return out


def test_labels_against_slow_rules():
    import random

    r = random.Random(1)
    words = ["the", "of", "and", "in", "zork", "blim", "quax", "mirn"]
    for _ in range(300):
        page = ""
        for _ in range(r.randrange(1, 12)):
            text = " ".join(r.choices(words, weights=r.choice([(1,) * 8, (3, 3, 3, 3, 1, 1, 1, 1), (0, 0, 0, 1, 3, 3, 3, 3)]), k=r.choice((2, 9, 20, 60))))
            if r.random() < 0.25:
                text = f"<a href=x>{text}</a> more"
            page += r.choice(("<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", "</article><article><p>{}</p>", "</article><p>{}</p>", "<article class=comment><p>{}</p></article>")).format(text)
        found = blocks(page)
        assert slow_labels(found) == [b.label for b in classify(found)]


def test_pages_without_a_marked_article():
    """The text is known: paragraphs of real words among menus, notices and link lists without any marks."""
    body = [f"{STOPS}{STOPS}Part {k} of it. " for k in range(4)]
    page = "<body><div><a href=/>Home</a> <a href=/x>All news</a></div><h1>Heading of it</h1>" + "".join(f"<p>{t}</p>" for t in body[:2]) + "<p>Short one.</p>" + "".join(f"<p>{t}</p>" for t in body[2:])
    page += "<ul><li><a href=1>One link here</a></li><li><a href=2>Another link</a></li></ul><p>© 2020 all rights</p></body>"
    assert main_text(page).split("\n\n") == ["Heading of it", body[0].strip(), body[1].strip(), "Short one.", body[2].strip(), body[3].strip()]


def test_marked_articles_go_through_the_rules():
    long, other = (STOPS * 3).strip(), "zork blim " * 30
    teaser = "<article><h2><a href=x>Another story</a></h2><p>Short word of it</p></article>"
    assert main_text(f"<article><h1>Top</h1><p>{long}</p><p>end</p></article>{teaser}{teaser}").split("\n\n") == ["Top", long, "end"]
    assert main_text(f"<article><p>{long}</p></article><article><p>bye</p></article>") == long + "\n\nbye"
    assert main_text(f"<article><p>{long}</p></article><p>{long}</p><article><p>{long}</p></article><p>{long}</p>") == "\n\n".join([long] * 3)
    assert main_text(f"<article><p>{other}</p><p><a href=x>all link</a></p></article>") == other.strip() + "\n\nall link"
    kept = "<article><h2 id='search'>Search algorithms</h2><p id='menu-1'>one</p><div class='social-history'>two</div><div class='share-bar'>no</div><section id=comments>no</section></article>"
    assert main_text(kept) == "Search algorithms\n\none\n\ntwo"
    assert main_text("<article><p data-x=it's>Hello world</p><p>Second para.</p><p it's a=b\"c>third</p></article>") == "Hello world\n\nSecond para.\n\nthird"


def test_unanswered_closing_tags_take_no_time():
    page = "<article>" + "<div><section>" * 8000 + "text" + "</aside></blockquote>" * 8000 + "</article>"
    begin = time.perf_counter()
    assert blocks(page)[0].text == "text"
    assert time.perf_counter() - begin < 1
    page = "<main>" * 3000 + "<p>x</p>"
    begin = time.perf_counter()
    assert main_text(page) == "x" and time.perf_counter() - begin < 1


def test_pages(spark):
    rows = [(1, "u", "<article><p>é</p></article>", "clash", 3), (None, None, None, "c", 1), (2, "v", "", "c", 1), (2, "v", "", "c", 1), (3, "w", "<article>" + "<p>word</p>" * 20000 + "</article>", "c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, id int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract_text(df).collect()}
    assert got[1, "u"] == ("é", 1) and got[None, None] == ("", 0) and got[2, "v"] == ("", 0) and got[3, "w"][1] == 20000 * 6 - 2
    assert extract_text(df).count() == 5 and extract_text(df.limit(0)).count() == 0
