import re
from html import unescape

from vectorloom.llm.pages import extract_text, main_text, op4_html

P = "The quick, brown fox jumps over the lazy dog; it was, after all, a fine day. "
LINE = P.strip()


def test_every_page_of_the_table(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for row in op4_html(spark, small).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[row.page_id], re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(x for x in lines if x) and row.n_chars == len(row.text)


def test_pages_of_the_table_without_their_article_tags(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        plain = re.sub(r"<(/?)article>", r"<\1div>", r.html)
        assert main_text(plain) == main_text(r.html)


STORY = [f"{w} {P * 2}".strip() for w in ("One", "Two", "Three", "Four", "Five")]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in STORY)


def test_a_story_beside_teasers_in_article_elements():
    cards = "".join(f"<article><h3><a href=/{k}>Card {k}</a></h3><p>Read on, now.</p></article>" for k in range(3))
    story = f"<div class=story><h1>Title</h1>{PARAGRAPHS}</div>"
    for page in (f"<body>{story}<div>{cards}</div></body>", f"<body><main>{story}<div>{cards}</div></main></body>"):
        assert main_text(page).split("\n") == ["Title", *STORY]
    assert main_text(f"<body>{story}<div class='related-posts'>{cards.replace('Read on', P * 2)}</div></body>").split("\n") == ["Title", *STORY]


def test_sibling_articles_all_stay():
    posts = [[f"{n} {x}" for x in STORY] for n in ("a", "b", "c")]
    page = "".join("<article>" + "".join(f"<p>{x}</p>" for x in post) + "</article>" for post in posts)
    assert main_text(f"<body><nav>{P}</nav>{page}</body>").split("\n") == [x for post in posts for x in post]


def test_names_that_only_hold_a_listed_word():
    side = "<div class=sidebar>x</div><div>About us</div>"
    for name in ("class='content has-comments'", "id='discussion-paper'", "class=no-sidebar", "class=adReport"):
        assert main_text(f"<body>{side}<div {name}>{PARAGRAPHS}</div></body>").split("\n") == STORY
    inner = f"<section class='share-price'><p>{LINE}</p></section><p class='notice-of-death'>He died.</p>"
    assert main_text(f"<article>{PARAGRAPHS}{inner}</article>").split("\n") == [*STORY, LINE, "He died."]


def test_marked_elements_that_hold_the_page():
    for wrap in ("<form action=/>{}</form>", "<div class=notice>{}</div>", "<div class=share><article>{}</article></div>"):
        page = f"<body><ul><li><a href=/>Home</a></ul>{wrap.format(PARAGRAPHS)}<footer>{P}</footer></body>"
        assert main_text(page).split("\n") == STORY
    talk = "".join(f"<li><p>{P * 3}</p></li>" for _ in range(40))
    assert main_text(f"<body><div>{PARAGRAPHS}</div><ol class='comment-list'>{talk}</ol></body>").split("\n") == STORY


def test_lists_and_titles_at_the_ends():
    points = "<ul><li>First point</li><li>Second</li></ul>"
    for page in (f"<body><div>Foo</div><div>{points}{PARAGRAPHS}</div></body>", f"<body><div>{PARAGRAPHS}{points}</div><div>Foo</div></body>"):
        assert sorted(main_text(page).split("\n")) == sorted([*STORY, "First point", "Second"])
    assert main_text(f"<body>{PARAGRAPHS}{points}<div>Foo</div></body>").split("\n") == [*STORY, "First point", "Second"]
    assert main_text(f"<body><div><h1>T</h1><div class=text>{PARAGRAPHS}</div></div></body>").split("\n") == ["T", *STORY]
    quoted = f"<body><div><p>Short, so.</p><blockquote><p>{P * 9}</p></blockquote><p>Said Ann.</p></div></body>"
    assert main_text(quoted).split("\n") == ["Short, so.", (P * 9).strip(), "Said Ann."]


def test_pages_without_semantic_tags():
    page = (
        "<html><body><div><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div>"
        f"<div><h2>My title</h2><div>{P * 3}</div><div>{P}</div><ul><li>Point one is here</li><li>Two</li></ul><div>{P * 4}</div></div>"
        "<div><p>Copyright 2024 Foo</p></div></body></html>"
    )
    assert main_text(page).split("\n") == ["My title", (P * 3).strip(), LINE, "Point one is here", "Two", (P * 4).strip()]


def test_boilerplate_goes():
    page = (
        f"<body><header><h1>Site</h1></header><main><h1>T</h1><p>{P}</p><p>Short.</p><aside>{P}</aside>"
        f"<section class='comments'><h2>Comments</h2><p>{P * 5}</p></section></main><div id=sideBar>{P * 4}</div>"
        f"<div class='cookie-notice'>{P}</div><form>{P}</form><div style='display: none'>{P}</div></body>"
    )
    assert main_text(page) == f"T\n{LINE}\nShort."


def test_broken_markup_and_references():
    page = (
        f"<body><div class='wrap has-sidebar'><article><header><h1>A &amp; B</h1></header><p>{P}<p>x&nbsp;y &#233;&copy "
        f"<a title='a > b' href=/>link</a> {P}<table><tr><td>1<td>2</table><!-- <p>no</p> --><script>if (a<b) x='</p>'</script>"
    )
    assert main_text(page) == f"A & B\n{LINE}\nx y é© link {LINE}\n1 2"
    assert main_text("") == "" and main_text("<nav>a</nav>") == "" and main_text("just words") == "just words"
    assert main_text("<p>Hi.<style>p{") == "Hi." and main_text("<" * 2000) is not None and main_text("<a b='" * 500) is not None


def test_rows_and_columns_stay(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_text(pages)
    assert found.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, "v", "")], key=repr)
    assert extract_text(pages.limit(0)).count() == 0
    long = f"<article>{''.join(f'<p>{P}</p>' for _ in range(20_000))}</article>"
    assert main_text(long).count("\n") == 19_999
