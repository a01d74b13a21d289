import json
import time

from chromaframe.llm.wrappers import align, extract_pages, fold, induce_wrappers, main_text, merge, parse_page


def page(i, body=None):
    body = body or f"<p>Text number {i} &amp; more &eacute;<br>line<p><b>Second {i}"
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>m{i}</li></ul></nav>"
            f"<div class='ad'>buy {i}</div><div class=box><div>Fixed line of the host</div><div class=story><h2>Head  {i}</h2>{body}</div></div>"
            f"<div id='comments'><p>reader {i}</p></div><form>f<input></form><footer>&copy; {i}</footer>")


def test_constant_slots_are_template(spark):
    rows = [(f"http://host.example/{i}", page(i), "x") for i in range(8)] + [("http://lone.example/a", page(1), "x"), (None, "<p>a&lt;b", "x"), ("http://x.example", None, "x"), ("http://x.example", "", "x")]
    df = spark.createDataFrame(rows, "url string, body string, main_text string").repartition(3)
    got = {(r.url, r.body): r.main_text for r in extract_pages(df).collect()}
    assert got["http://host.example/3", page(3)] == "Head 3\n\nText number 3 & more é line\n\nSecond 3"
    assert got["http://lone.example/a", page(1)].startswith("Fixed line of the host\n\nHead 1")
    assert got[None, "<p>a&lt;b"] == "a<b" and got["http://x.example", None] == got["http://x.example", ""] == ""
    wrapper = {r.host: json.loads(r.wrapper) for r in induce_wrappers(df).collect()}
    assert wrapper["host.example"][1] == 8
    assert extract_pages(df.limit(0)).count() == 0


def test_landmarks_bound_the_article():
    html = "<body><p>teaser</p><article><header><h1>T</h1></header><p>One<aside>no</aside> two</p><ul><li>a<li>b</ul><div class='share-bar'>s</div></article><p>after"
    assert main_text(html, None) == "T\n\nOne\n\ntwo\n\na\n\nb"
    assert main_text("x <b>y</b>z &am; <!-- c <p> --> w < 3 <p class", None) == "x yz &am; w < 3"
    assert main_text("<div>" * 5000 + "deep", None) == "deep"
    assert main_text("<article>" + "<p>w" * 3000, None).count("w") == 3000


def test_pages_of_one_text_are_kept():
    one = fold(parse_page("<p>only</p>"))
    for _ in range(9):
        one = merge(one, fold(parse_page("<p>only</p>")))
    assert one[1] == 10 and main_text("<p>only</p>", one) == "only"


def test_simple_tree_matching():
    tree = lambda html: fold(parse_page(html))[4]
    a, b = tree("<h1>x</h1><ul><li>1</ul><p>y</p>"), tree("<div>n</div><h1>z</h1><p>w</p>")
    assert [(a[i][0], b[j][0]) for i, j, _ in align(a, b)] == [("h1", "h1"), ("p", "p")]


def test_names_alone_do_not_hide_an_article():
    art = "<article><h1>T</h1><p>One two</p></article>"
    for html in (f"<body class='no-sidebar'>{art}", f"<div class='post with-comments'>{art}</div>", f"<div class='content-sidebar-wrap'><main>{art}</main></div>",
                 f"<html class='social-ready'><body class='ad-free menu'>{art}", f"<div class='widget-area'>{art}</div>"):
        assert main_text(html, None) == "T\n\nOne two", html
    assert main_text("<article><p class='share-price'>It rose</p><p>by <a class='widget-link'>nine</a></p></article>", None) == "It rose\n\nby nine"
    comments = "<div id='comments'><article class='comment-body'>reader</article></div>"
    assert main_text(f"<p>Body</p>{comments}<p class='ad'>buy</p><div class='cookie-note'>c</div>", None) == "Body"


def test_broken_pages_take_no_longer_than_their_length():
    began = time.time()
    for piece in ("<div", "<a <b c ", "</p ", "<!-- x", "<a 'b", '<a "', "<!x ", "< "):
        main_text(piece * 120_000, None)
        main_text("<p>ok</p>" + piece * 60_000 + ">", None)
    assert main_text("<p>ok</p>" + "<div" * 1000, None) == "ok"
    assert time.time() - began < 40


def test_wide_hosts_keep_their_template():
    body = "".join(f"<div class='{a}{b}'>fixed {a}{b}</div>" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwx")
    pages = [f"<body><p>own {i}</p>{body}<div class='z{chr(97 + i)}q'>only {i}</div>" for i in range(8)]
    wrapper = fold(parse_page(pages[0]))
    for p in pages[1:]:
        wrapper = merge(wrapper, fold(parse_page(p)))
    assert main_text(pages[3], wrapper) == "own 3\n\nonly 3"
    slots = lambda names: [[n, 1, 0, 0, []] for n in names]
    a, b = [f"s{i}" for i in range(400)], [f"s{i}" for i in range(400) if i % 7] + ["new"]
    b[10:10] = ["x", "x"]
    assert [(a[i], b[j]) for i, j, _ in align(slots(a), slots(b))] == [(n, n) for n in a if int(n[1:]) % 7]

