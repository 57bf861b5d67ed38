from __future__ import annotations

import random

from pyspark.sql import functions as F

from communitylens.llm import wrappers


def page(title, paragraphs, extra=""):
    return (
        '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>'
        f'<nav><ul><li><a href="/x">{title[:3]} menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy {len(title)}</div>'
        f"<div class='site'><span>Always the same</span></div><div id=\"story\"><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        + f"</div>{extra}<form><input name=q><button>Send</button></form><div class='user-comments'><p>Me too {title}</p></div><footer>&copy; {title}</footer></body></html>"
    )


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select(
        "*", *[F.lit("x").alias(c) for c in ("host", "h", "place", "fixed", "text", "path")]).repartition(3)
    return sorted(((r.page_id, r.text) for r in wrappers.extract(df).collect()), key=str)


def test_varying_slots_are_the_article(spark):
    pick = random.Random(6)
    rows, want = [], []
    for i in range(40):
        title, paragraphs = f"Title {i}", [" ".join(pick.choice(["alpha", "beta", "gamma"]) for _ in range(pick.randint(5, 60))) for _ in range(pick.randint(1, 9))]
        rows.append((i, f"https://{'a' if i % 3 else 'B'}.example.org/p/{i}?x=1", page(title, paragraphs)))
        want.append((i, "\n".join([title, *paragraphs])))
    assert extracted(spark, rows) == sorted(want, key=str)


def test_without_evidence_all_content_stays(spark):
    html = page("Alone", ["first &lt;p&gt;", "second\n  line"])
    want = "Always the same\nAlone\nfirst <p>\nsecond line"
    assert extracted(spark, [(1, "http://one.example/", html), (2, "http://two.example/a", html), (2, "http://two.example/b", html)]) == [(1, want), (2, want), (2, want)]


def test_article_elements_keep_repeated_paragraphs(spark):
    rows = [(i, f"http://x.example/{i}", f"<body><div>same frame</div><article><h1>Head {i}</h1><p>text {i} " + "long " * 20 + "<p>Same licence.</article><aside>side</aside>") for i in range(5)]
    assert extracted(spark, rows) == [(i, f"Head {i}\ntext {i} " + " ".join(["long"] * 20) + "\nSame licence.") for i in range(5)]


def test_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [
        (1, None, "<p>no url"), (2, "http://h.example", None), (3, "http://h.example", ""), (4, "not a url", "plain &eacute;&#233; text"), (None, "http://n.example/", "<p>a<br>b</p>tail"),
        (5, "http://d.example/", deep), (6, "http://l.example/", "<p>" + "word " * 50_000), (7, "http://m.example/", "<!-- never closed <p>x"),
        (8, "http://s.example/", "<script>never closed <p>x"), (9, "http://e.example/", "<nav><p>menu</nav>"), (10, "http://q.example/", "a < b <p>c > d"),
    ]
    got = dict(extracted(spark, rows))
    assert got == {
        1: "no url", 2: "", 3: "", 4: "plain éé text", None: "a b\ntail", 5: "deep", 6: " ".join(["word"] * 50_000), 7: "", 8: "", 9: "", 10: "a < b\nc > d",
    }
    assert extracted(spark, []) == []


def test_matching_keeps_order_and_size():
    a, b = (wrappers.slots(wrappers.parse(x)) for x in ("<div><p>1</p><ul><li>2</li></ul><p>3</p></div>", "<div><ul><li>x</li></ul><p>y</p><p>z</p></div>"))
    size, pairs = wrappers.match(a, b)
    assert size == 5  # root, div, ul, li slot, p slot
    assert [x.kind for x, _ in pairs][0] == "#root"


def test_parts_that_match_nothing_join_the_wrapper():
    wrapper = wrappers.Wrapper(wrappers.slots(wrappers.parse("<div><p>1</p></div>")))
    wrapper.add(wrappers.slots(wrappers.parse("<div><p>2</p><table><tr><td>x</td></tr></table></div>")))
    rows = {path: (pages, varies) for path, _, pages, _, varies, _ in wrapper.rows()}
    assert rows["/div[0]/p[0]"] == (2, True) and rows["/div[0]/table[0]/tr[0]"][0] == 1


def texts(html):
    return wrappers.main_text(html, None, set())


def test_inline_noise_takes_only_its_own_text():
    page = '<article><p>a <a class="social">x</a> b</p><p>c <span class="hidden">y <span>z</span> y</span>d<i id="comment-3">e</i>f</p><p>g</p></article>'
    assert texts(page) == "a b\nc df\ng"
    assert texts('<article><div>a <span class="share"><div>x</div> x</span> b</div><p>c</p></article>') == "a b\nc"
    assert texts('<article><p>a <a class="social">never closed<p>b</p><p>c <b class="share">x</p><p>d</p></article>') == "a\nb\nc\nd"


def test_names_of_containers_do_not_drop_the_page():
    story = "<h1>Head</h1><p>" + "long " * 30 + "</p><p>end</p>"
    want = "Head\n" + " ".join(["long"] * 30) + "\nend"
    aside = '<div class="sidebar"><p>side</p></div>'
    for page in (
        f'<body class="home has-sidebar"><div>{story}</div>{aside}</body>', f'<main class="with-comments">{story}{aside}</main>',
        f'<article class="post share-enabled">{story}{aside}</article>', f'<div class="content no-sidebar">{story}</div>{aside}',
        f'<main><div class="content no-sidebar">{story}{aside}</div></main>', f'<div data-id="menu" data-role="hidden">{story}</div>{aside}',
        f'<article>{story}</article><section id="comments"><p>{"reply " * 200}</p></section>',
    ):
        assert texts(page) == want
    assert texts('<article></article><div class="ad">Buy</div>') == ""


def test_copies_are_one_page_of_their_host(spark):
    rows = [(i, f"http://c.example/{i}", f"<div>frame</div><div id=story><h1>Head {i}</h1><p>text {i} " + "long " * 20 + "</p></div>") for i in range(8)]
    copy = "<div>frame</div><div id=story><h1>Head c</h1><p>text c " + "more " * 20 + "</p><h2>Only here</h2><p>second</p></div>"
    rows += [(100 + i, f"http://c.example/copy/{i}", copy) for i in range(30)]
    got = dict(extracted(spark, rows))
    assert got[100] == got[129] == "Head c\ntext c " + " ".join(["more"] * 20) + "\nOnly here\nsecond"
    assert got[3] == "Head 3\ntext 3 " + " ".join(["long"] * 20)


def test_a_template_is_what_reads_like_it():
    page = wrappers.slots(wrappers.parse("<div><p>frame</p><h2>x</h2><p>frame</p></div>"))
    mark = wrappers._mark(dict(wrappers._paths(page))["/div[0]/p[0]"])
    fixed = {f"{mark} /div/p"}
    assert wrappers.main_text("<div><p>frame</p><h2>x</h2></div>", None, fixed) == "x"
    assert wrappers.main_text("<div><p>other</p><h2>x</h2></div>", None, fixed) == "other\nx"


def test_content_in_several_elements_is_kept_whole(spark):
    html = "<div>frame</div><div id=story><div class=lead><h1>Head {0}</h1><p>lead {0} {1}</p></div><div class=text><p>text {0} {2}</p></div></div><div class=note><p>note {0}</p></div>"
    rows = [(i, f"http://t.example/{i}", html.format(i, "some " * 35, "long " * 65)) for i in range(6)]
    want = "Head {0}\nlead {0} " + " ".join(["some"] * 35) + "\ntext {0} " + " ".join(["long"] * 65) + "\nnote {0}"
    assert extracted(spark, rows) == [(i, want.format(i)) for i in range(6)]


def test_names_inside_an_article_need_to_say_nothing_else(spark):
    pick, rows, want = random.Random(4), [], []
    for i in range(12):
        words = " ".join(pick.choice(["one", "two", "three"]) for _ in range(30))
        rows.append((i, f"http://names.example/{i}", f'<body><div class="top">frame</div><article><h1>Head {i}</h1><p>{words}</p>'
                     f'<p class="share-price">The share price rose {i} percent.</p><table class="search-results"><tr><td>found {i}</td></tr></table>'
                     f'<p>at <span class="comment-free-zone">half {i}</span> past</p><div class="share-buttons">tweet {i}</div>'
                     f'<section class="comments"><p>me {i}</p></section><div class="newsletter">join {i}</div><ul class="post-related-links"><li>more {i}</li></ul></article></body>'))
        want.append((i, f"Head {i}\n{words}\nThe share price rose {i} percent.\nfound {i}\nat half {i} past"))
    assert extracted(spark, rows) == sorted(want, key=str)


def test_a_template_paragraph_before_the_story(spark):
    pick, rows, want = random.Random(5), [], []
    for i in range(12):
        story = [" ".join(pick.choice(["one", "two", "three"]) for _ in range(25)) for _ in range(2 + i % 4)]
        body = "".join(f"<p>{p}</p>" for p in story)
        rows.append((i, f"http://lead.example/{i}", f"<body><div id='top'><b>frame</b></div><div id='story'><p>Read more on our site today.</p>{body}</div></body>"))
        want.append((i, "\n".join(story)))
    assert extracted(spark, rows) == sorted(want, key=str)


def test_template_behind_a_part_that_only_some_pages_have(spark):
    pick, rows, want = random.Random(7), [], []
    for i in range(12):
        story = " ".join(pick.choice(["one", "two", "three"]) for _ in range(25))
        extra = f"<section><p>extra {i} {story[:19].strip()}</p></section>" if i % 2 else ""
        rows.append((i, f"http://shift.example/{i}", f"<body>{extra}<section><p>Home of the news</p></section><div><p>{story}</p></div></body>"))
        want.append((i, "\n".join(([f"extra {i} {story[:19].strip()}"] if i % 2 else []) + [story])))
    assert extracted(spark, rows) == sorted(want, key=str)


def test_versions_of_one_story_keep_what_they_share(spark):
    rows = [(i, f"http://versions.example/{i}", f"<body><div><p>stays here in full</p><p>and this too</p><p>version {i}</p></div></body>") for i in range(10)]
    assert extracted(spark, rows) == sorted(((i, f"stays here in full\nand this too\nversion {i}") for i in range(10)), key=str)
