import random
import time

from matchloom.llm import page_text as p

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<div id="cookie-notice">We use cookies, ok.</div><main><article class="post-12"><header><h1>Title &amp; more</h1><p>By Bob</p></header>
<div class="entry-content"><p>First para, with text. And more words here.<p>Second para &lt;b&gt; &nbsp; x<br>y, long
enough to count. <ul><li>one<li>two</ul><div class="ad">BUY</div><form><label>mail</label></form></div></article>
<section class="comments"><article class="comment"><p>Nice, article. I like it a lot, really, yes.</p></article></section></main>
<aside><p>Side, bar. text text</p></aside><footer>&copy; foot</footer><script>if(a<b){"</p>"}</script></body></html>"""
WANT = "Title & more\nFirst para, with text. And more words here.\nSecond para <b> x y, long enough to count.\none\ntwo"


def test_main_text_of_one_page():
    assert p.extract(PAGE, None) == WANT
    assert p.extract(PAGE, p.path_key(["html", "body", "main", "article.post-#"])) == WANT
    assert p.extract("", None) == p.extract("<p", None) == ""
    assert p.extract("<body><article><p>cut off &amp; he", None) == "cut off & he"
    assert p.extract("<body><article><p>a<p clas", None) == "a"
    assert p.extract("<body><div>plain < text > here, ok.</div>", None) == "plain < text > here, ok."


def test_hosts_agree_on_a_path(spark, monkeypatch):
    body = lambda k: f'<html><body><div class="c{k}"><p>{"Words, and more words. " * 9}</p></div><div class="rail"><p>{"Other, text. " * (1 if k < 9 else 60)}</p></div></body></html>'
    rows = [(i, f"https://A.example/{i}", body(i)) for i in range(10)] + [(50, None, None), (51, "nonsense", ""), (52, "https://b.example", PAGE), (52, "https://b.example", PAGE), (None, "https://b.example", PAGE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, p.page_text(df).collect()), key=repr)
    by = {r[0]: r[2] for r in got}
    assert by[9].startswith("Words, and") and by[50] == by[51] == "" and by[52] == by[None] == WANT
    assert all(len(r[2]) == r[3] for r in got) and len(got) == len(rows)
    monkeypatch.setattr(p, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, p.page_text(df).collect()), key=repr) == got
    assert p.page_text(df.filter("false")).count() == 0


def test_class_words_do_not_drop_an_article():
    para = "<p>" + "Long text, with commas. " * 12 + "</p>"
    text = ("Long text, with commas. " * 12).strip()
    rail = '<div class="rail">Read other things</div>'
    for page in (
        f'<body><div class="content has-sidebar">{para}</div>{rail}</body>',
        f'<body><article class="post category-search">{para}</article>{rail}</body>',
        f'<body><div class="content"><p class="no-ads">{para[3:]}</div>{rail}</body>',
        f'<body><div class="content"><div class="related-work">{para}</div></div>{rail}</body>',
        f'<body><div class="newsletter-archive">{para}</div></body>',
    ):
        assert p.extract(page, None) == text
    for head in ('<header class="entry-header"><h1>Title</h1><p>By me</p></header>', '<div class="post-header"><h1>Title</h1></div>'):
        assert p.extract(f"<body><article>{head}{para}</article>{rail}</body>", None) == "Title\n" + text
    more = '<div class="related-posts"><a href="x">One more story</a> <a href="y">Another</a></div><div id="comments"><p>' + "So true, I say. " * 60 + "</p></div>"
    assert p.extract(f"<body><div class=content>{para}{more}</div></body>", None) == text


def test_deep_broken_and_long_pages_take_linear_time():
    began = time.perf_counter()
    deep = "<div>" * 50_000 + "<p>Deep, text.</p>" + "</section>" * 50_000
    assert p.extract(deep, None) == "Deep, text."
    assert p.extract("<blockquote><li>" * 30_000 + "x, y.", None) in ("", "x, y.")
    long = "<body><article>" + "<p>Some words, here.</p>" * 200_000 + "</article></body>"
    assert p.extract(long, None).count("\n") == 199_999
    assert time.perf_counter() - began < 60


def test_generated_pages_against_what_they_were_made_of():
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta, epsilon. zeta".split()) for _ in range(n))
    clutter = ["<nav><a>{}</a></nav>", "<div class='ad'>{}</div>", "<form>{}</form>", "<aside>{}</aside>", "<div class='cookie-notice'>{}</div>", "<script>{}</script>", "<style>{}</style>", "<ul class='menu'><li><a>{}</a></ul>", "<!-- {} -->"]
    for _ in range(60):
        parts, want = [], []
        for _ in range(rng.randint(3, 9)):
            text = words(rng.randint(15, 60))
            kind = rng.choice(["p", "h2", "li", "blockquote"])
            parts.append(f"<{kind}>{text.replace('beta', '<b>beta</b>').replace('zeta', 'z&#101;ta')}</{kind}>")
            want.append(text)
            if rng.random() < 0.4:
                parts.append(rng.choice(clutter).format(words(8)))
        around = [rng.choice(clutter).format(words(10)) for _ in range(4)]
        box = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>"])
        page = f"<html><body><header>{words(5)}</header>{around[0]}{around[1]}{box.format(' '.join(parts))}{around[2]}{around[3]}<div class='comments'><p>{words(40)}</p></div><footer>{words(9)}</footer></body></html>"
        assert p.extract(page, None) == "\n".join(want)


def test_pages_without_a_body():
    long = "This is an article of some length, with commas, and with sentences. " * 5
    assert p.extract(f"<p>{long}</p>", None) == long.strip() and p.extract(long, None) == long.strip()
    assert p.extract(f"<title>t</title><nav>a b c</nav><h1>Head</h1><p>{long}</p><footer>foot</footer>", None) == "Head\n" + long.strip()
    assert p.extract(f"<div class='content'><p>{long}</p></div><div class='sidebar'>side</div>", None) == long.strip()
    assert p.extract(f"<html><body><div><p>{long}</p></div></body></html> after", None) == long.strip() and p.extract("", None) == ""
