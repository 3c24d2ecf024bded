import re

from collections import Counter

import pytest

from spanforge.llm.html_extract import BROADCAST_BYTES, blocks, deduce, extract, main_text, names_boilerplate, templates, text_key

SF = "/root/testdata/sf0.01"


def page(body, menu="Home", foot="(c) us"):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>{menu}</a></li></ul></nav>{body}<footer>{foot}</footer></body></html>"


def test_blocks_and_references():
    text = main_text(page("<!-- x --><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three &eacute;&#33;<script>var a='<p>'</script></p><ul><li>i<li>j</ul><div class='comments'>me too</div></article>"), set(), set())
    assert text == "A & B\n\none two\n\nthree é!\n\ni\n\nj"


def test_unclosed_and_stray():
    assert main_text("<p>a</b> < b & c<div>d", set(), set()) == "a < b & c\n\nd"
    assert main_text("plain", set(), set()) == "plain"
    assert main_text("<nav><ul><li>menu<article><p>text</article>", set(), set()) == "text"
    assert main_text("<article><p>a<!-- open", set(), set()) == "a"


WORDS = "x " * 100


def hosted(spark, bodies, body_tag="<body>"):
    whole = [f"<html><head><title>t</title></head>{body_tag}{b}</body></html>" for b in bodies]
    return spark.createDataFrame([(i, f"http://h.example/{i}", w) for i, w in enumerate(whole)], "page_id long, url string, html string")


def texts(spark, bodies, body_tag="<body>"):
    return {x.page_id: x.text for x in extract(hosted(spark, bodies, body_tag)).collect()}


def test_root_without_article(spark):
    bodies = [f"<div class='top'>Daily news of {i}</div><div class='c' id='c{i}'><h2>T{i}</h2><p>text of page {i} {WORDS}</p></div><p class='foot'>about</p>" for i in range(6)]
    df = hosted(spark, bodies)
    assert [t.roots for t in templates(df.selectExpr("*", "'h' as host")).collect()] == [[">html>body>div.c"]]
    assert texts(spark, bodies) == {i: f"T{i}\n\ntext of page {i} {WORDS.strip()}" for i in range(6)}


def test_several_slots_stay(spark):
    """No child holds nearly all of the text, so all of their parent's slots are the article."""
    bodies = [f"<div class='a'><div class='one'>first {i} {WORDS}</div><div class='two'>second {i} {WORDS}</div></div>" for i in range(4)]
    assert texts(spark, bodies) == {i: f"first {i} {WORDS}\n\nsecond {i} {WORDS}".replace(" \n", "\n").strip() for i in range(4)}


def test_template_text_inside_the_root(spark):
    bodies = [f"<article><h1>T{i}</h1><p>body {i}</p><div class='legal'><p>All <b>rights</b> reserved by us</p></div></article>" for i in range(5)]
    assert texts(spark, bodies) == {i: f"T{i}\n\nbody {i}" for i in range(5)}
    # A text that repeats on fewer than half of the pages is no template.
    bodies = [f"<article><h1>T{i}</h1><p>{'shared' if i < 2 else f'own {i}'}</p></article>" for i in range(5)]
    assert texts(spark, bodies) == {i: f"T{i}\n\n{'shared' if i < 2 else f'own {i}'}" for i in range(5)}


def test_error_pages_do_not_empty_the_template(spark):
    bodies = [f"<article><h1>T{i}</h1><p>body {i}</p><p class='legal'>Rights reserved</p></article>" for i in range(6)] + ["<p>Not found", ""]
    got = texts(spark, bodies)
    assert [got[i] for i in range(8)] == [*(f"T{i}\n\nbody {i}" for i in range(6)), "Not found", ""]


def test_two_pages_have_no_template(spark):
    bodies = ["<article><p>same text</p><p>one</p></article>", "<article><p>same text</p><p>two</p></article>"]
    assert texts(spark, bodies) == {0: "same text\n\none", 1: "same text\n\ntwo"}


@pytest.mark.parametrize("body_tag", ["<body class='home no-sidebar'>", "<body class='menu-open' id='nav'>", "<body>"])
@pytest.mark.parametrize("before,after", [("<article>", "</article>"), ("<main><article class='promo-story'>", "</article></main>"), ("<div class='content no-sidebar has-menu'>", "</div>"), ("<main class='sidebar'>", "</main>")])
def test_ordinary_class_names(spark, body_tag, before, after):
    bodies = [f"<nav>menu</nav><div class='site-header'></div>{before}<p>body {i} {WORDS}</p><div class='comment-list'>nice</div>{after}<div class='ad-slot'>buy {i}</div>" for i in range(4)]
    assert texts(spark, bodies, body_tag) == {i: f"body {i} {WORDS.strip()}" for i in range(4)}


def test_boilerplate_names():
    for name in ("ad", "ads top", "site-footer", "cookie_banner", "comment-list", "relatedPosts", "sidebar-2", "main-nav"):
        assert names_boilerplate("div", name), name
    for name in ("no-sidebar", "menu-open", "has-ads", "promo-story", "navigate", "header", "shared", "commentary", ""):
        assert not names_boilerplate("div", name), name


def test_text_in_named_elements_only_is_kept():
    assert main_text("<div class='widget'><p>all there is</p></div>", set(), set()) == "all there is"
    assert main_text("<div class='widget'><p>no</p></div><p>yes</p>", set(), set()) == "yes"
    assert main_text("<p>buy <span class='ad'>now</span> here</p>", set(), set()) == "buy here"


def test_repeated_pages_keep_their_text(spark):
    """Equal rows, equal html under three addresses, one story on 3 of 5 pages, pages that differ in nothing but a comment."""
    foot = "<div class='end'>About us</div>"
    story = f"<article><h1>Agency</h1><p>The same story {WORDS}</p><p>Its end</p></article>{foot}"
    whole = f"Agency\n\nThe same story {WORDS.strip()}\n\nIts end"
    row = (1, "http://a.example/x", f"<html><body>{story}</body></html>")
    got = extract(spark.createDataFrame([row] * 3 + [(i, f"http://b.example/x?utm={i}", row[2]) for i in range(3)], "page_id long, url string, html string")).collect()
    assert len(got) == 6 and {x.text for x in got} == {whole}
    own = [f"<article><h1>T{i}</h1><p>body {i}</p></article>{foot}" for i in range(2)]
    assert texts(spark, [story + f"<!-- {i} -->" for i in range(3)] + own) == {0: whole, 1: whole, 2: whole, 3: "T0\n\nbody 0", 4: "T1\n\nbody 1"}
    assert texts(spark, [f"<!-- {i} -->{story}" for i in range(4)]) == {i: whole for i in range(4)}
    assert texts(spark, [story] * 4 + own + [own[0]] * 3) == {**{i: whole for i in range(4)}, 4: "T0\n\nbody 0", 5: "T1\n\nbody 1", **{i: "T0\n\nbody 0" for i in (6, 7, 8)}}


def test_copies_count_once_in_both_joins(spark, monkeypatch):
    """Many copies of one page do not outvote the others, with the copies' table sent and shuffled."""
    bodies = [f"<article><h1>T{i}</h1><p>body {i}</p><p class='legal'>Rights reserved</p></article>" for i in range(4)] + ["<p>Error"] * 30
    want = {**{i: f"T{i}\n\nbody {i}" for i in range(4)}, **{i: "Error" for i in range(4, 34)}}
    assert texts(spark, bodies) == want
    monkeypatch.setattr("spanforge.llm.html_extract.BROADCAST_BYTES", -1)
    assert texts(spark, bodies) == want


def brute_force(pages):
    """Roots and constants of a host from whole occurrence vectors over its different pages."""
    pages = list(dict.fromkeys(pages))
    vectors, chars = {}, Counter()
    for i, page in enumerate(pages):
        opened = []
        for text, _, chain in blocks(page, opened):
            path = chain[-1][1] if chain else ""
            vectors.setdefault((path or ">", text_key(path, text)), Counter())[i] += 1
            chars[path or ">", text_key(path, text)] += len(text)
            for c in {c[1] for c in chain}:
                chars[c, 0] += len(text) * sum(c == d[1] for d in chain)
        for path in opened:
            vectors.setdefault((path, 0), Counter())[i] += 1
    number = {}
    tokens = [(p, k, number.setdefault(tuple(sorted(v.items())), len(number)), sum(v.values()), len(v), chars[p, k]) for (p, k), v in vectors.items() if 2 * len(v) >= len(pages)]
    return deduce(len(pages), tokens)


def test_sketches_give_the_classes_of_whole_vectors(spark):
    import random

    r = random.Random(4)
    for _ in range(4):
        pages = []
        for i in range(r.randint(3, 9)):
            parts = [f"<p>t{r.randint(0, 3)}</p>" if r.random() < 0.5 else f"<div class='k{'ab'[r.randint(0, 1)]}'>w{r.randint(0, 2)} <b>z</b></div>" for _ in range(r.randint(1, 6))]
            pages.append(f"<html><body><div class='m'>{''.join(parts)}</div>" + ("<section>fixed</section>" if r.random() < 0.8 else "") + f"<!-- {i} -->")
        pages += pages[:1] * r.randint(0, 5)
        df = spark.createDataFrame([(i, "u", p, "h") for i, p in enumerate(pages)], "page_id long, url string, html string, host string")
        (got,) = templates(df).collect()
        roots, constants, classes = brute_force(pages)
        assert got.roots == roots and sorted(c % 2**64 for c in got.constants) == constants and sorted(got.classes) == sorted(classes)


def test_join_over_salts_gives_the_same(spark, monkeypatch):
    df = hosted(spark, [f"<article><p>body {i}</p><p>fixed</p></article>" for i in range(40)])
    want = sorted(extract(df).collect())
    monkeypatch.setattr("spanforge.llm.html_extract.BROADCAST_BYTES", -1)
    assert BROADCAST_BYTES > 0 and sorted(extract(df).collect()) == want


def test_odd_rows(spark):
    rows = [(1, "http://a.example/", None, "z"), (1, "http://a.example/", None, "z"), (2, None, "", "z"), (None, "no url", "<article>x</article>", "z"), (3, "http://b.example/", "<article><p>" + "w " * 200_000 + "</p></article>", "z")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got) == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 399_999)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table(spark):
    """Against the one skeleton that all pages of the table have."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for p in pages.collect():
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want[p.page_id] = "\n\n".join(b for b in parts if b)
    assert {x.page_id: x.text for x in extract(pages).collect()} == want
