import html
import re
import time

from skyloom.llm.html_text import html_text, main_text


def article(page):
    """The main text of the given pages, by their one markup."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    lines = (html.unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"</?p>|<br>|</?h1>", inner))
    return "\n".join(x for x in (" ".join(x.split()) for x in lines) if x)


def test_given_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    got = {r["page_id"]: r for r in html_text(df).collect()}
    for r in df.collect():
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


LONG = "A sentence of the story, with some commas, and with enough letters to be a paragraph of running text in its own right. "


def test_without_an_article_element():
    body = "".join(f"<p>{LONG}Part {i} &amp; more&nbsp;text.</p>" for i in range(4))
    page = f"""<html><head><title>T</title></head><body><div id=header><a href=/>Home</a></div><ul class="nav-menu"><li><a href=a>A</a><li><a href=b>B</a></ul>
      <div class="content"><h2>Heading</h2>{body}<div class="share-buttons">Tweet, this</div><form><input><p>{LONG}</p></form></div>
      <div class="sidebar"><p>{LONG}{LONG}</p></div><div id="comments"><p>{LONG}{LONG}</p></div><p class=cookie-notice>{LONG}</p><p style="Display: none">{LONG}</p>
      <div class=links>{"".join(f"<p><a href=x>{LONG}</a></p>" for _ in range(9))}</div><footer>c</footer><script>var p="<p>{LONG}</p>"</script></body></html>"""
    want = "\n".join(["Heading", *[f"{LONG}Part {i} & more text." for i in range(4)]])
    assert main_text(page) == want


def test_siblings_inline_and_broken_markup():
    page = f"<body><div><p>One <b>bold</b><i> word</i>,\n\t tail &lt;x&gt; &#233;<p>{LONG}<ul><li>item<li>other <a href=q>linked</a></ul><table><tr><td>c1<td>c2</table></div>"
    assert main_text(page) == f"One bold word, tail <x> é\n{LONG.strip()}\nitem\nother linked\nc1\nc2"
    assert main_text("") == "" and main_text("<") == "<" and main_text("<p>") == "" and main_text("just text & more") == "just text & more"
    assert main_text("<nav><a href=x>Home</a></nav>") == ""
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>x</p>"), (3, "u", "<article><p>x y</p></article>"), (3, "u", "<article><p>x y</p></article>")]
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in html_text(df).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, None, "x", 1), (3, "u", "x y", 3), (3, "u", "x y", 3)], key=repr)
    assert html_text(df.limit(0)).collect() == []


def test_wrappers_with_unwanted_words():
    body = "".join(f"<p>{LONG}Part {i}.</p>" for i in range(4))
    want = "\n".join(f"{LONG}Part {i}." for i in range(4))
    side = f'<div class="sidebar"><p>{LONG}</p></div><div class="post-comments"><p>{LONG * 9}</p></div><div class="comment-content"><p>{LONG}</p></div>'
    comments = f'<div id="comments"><article class="comment-body"><p>{LONG}</p></article><article><p>{LONG}</p></article></div>'
    for page in (
        f'<div class="content-sidebar-wrap"><main class="content">{body}</main>{side}</div>', f'<div class="content has-sidebar">{body}</div>{side}',
        f'<div class="post no-comments">{body}{side}</div>', f'<div class="content-sidebar-wrap">{body}</div>{side}',
        f'<div id="nav-layout"><article>{body}</article>{comments}</div>{comments}{side}', f'<div class="has-sidebar">{body}</div>{side}'):
        assert main_text(f"<html><body>{page}<footer>f</footer></body></html>") == want


def test_article_in_several_containers():
    body = "".join(f"<p>{LONG}Part {i}.</p>" for i in range(4))
    want = [f"{LONG}Part {i}." for i in range(4)]
    links = "<p><a href=x>Next story</a></p><ul><li><a href=x>a</a><li><a href=y>b</a></ul><div><a href=x>More</a></div>"
    for after, lines in (
        ("<p>Short end.</p>", ["Short end."]), ("<section><p>One.</p><p>Two.</p></section>", ["One.", "Two."]), ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("<table><tr><td>a<td>b</table>", ["a", "b"]), ("Loose <b>end</b> of it, <a href=q>see</a>.", ["Loose end of it, see."]),
        ('<div class="sidebar"><p>Side.</p></div><p>End.</p>', ["End."])):
        assert main_text(f"<body><div><div>{body}</div>{after}{links}</div></body>") == "\n".join(want + lines)
        assert main_text(f"<body><main><div><div><div>{body}</div></div>{after}</div></main></body>") == "\n".join(want + lines)


def test_forms_dialogs_and_names_that_hold_text():
    body = "".join(f"<p>{LONG}Part {i}.</p>" for i in range(4))
    want = "\n".join(f"{LONG}Part {i}." for i in range(4))
    for page in (f"<body><form id=aspnet><input type=hidden>{body}<label>Search</label></form></body>",
                 f"<body><form><div class=content>{body}</div><div class=sidebar><p>{LONG}</p></div></form></body>",
                 f"<body><form><main>{body}</main></form></body>",
                 f"<body><main>{body}</main><form><p>{LONG}</p></form><div role=dialog><p>{LONG}</p></div><div aria-modal=true><p>{LONG}</p></div><dialog open><p>{LONG}</p></dialog></body>",
                 f"<body><main>{body}</main><section><h2>Comments (2)</h2><p>{LONG}</p><p>{LONG}</p></section><div><h3>3 comments</h3><p>{LONG}</p></div></body>"):
        assert main_text(page) == want, page
    kept = f"<article><p>{LONG}</p><p class=share-price>{LONG}price</p><table class=social-data><tr><td>{LONG}data</td></tr></table><p class=share>Share this</p><div class=share-buttons>Tweet</div></article>"
    assert main_text(f"<body>{kept}</body>") == "\n".join([LONG.strip(), f"{LONG}price", f"{LONG}data"])
    headed = f"<article><h1>Comments</h1><p>{LONG}</p><p>{LONG}</p></article>"  # an article on comments
    assert main_text(f"<body><div>{headed}</div></body>") == "\n".join(["Comments", LONG.strip(), LONG.strip()])


def test_time_in_proportion_to_the_page():
    start = time.process_time()
    for page in ("<div>" * 100_000 + "deep", "<b>" * 50_000 + "<p>x" * 20_000, "<p><table>" + "<b>" * 50_000 + "<div>y</div>" * 20_000, "<h1>" * 50_000 + "</i>" * 50_000):
        main_text(page)
    assert time.process_time() - start < 20
