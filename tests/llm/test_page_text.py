import re
from html import unescape

import numpy as np

from callglass.llm import page_text


def text(html, spark=None):
    tree = page_text.Tree(page_text.LABELLED)
    found = page_text.blocks(html)
    if not found:
        return ""
    t, *rest = zip(*found)
    keep = tree(page_text.features(*map(np.array, rest), np.zeros(len(found))))
    return "\n".join(x for x, k in zip(t, keep) if k)


def test_tree_fits_its_table():
    tree = page_text.Tree(page_text.LABELLED)
    assert (tree(page_text.LABELLED[:, :-1]) == page_text.LABELLED[:, -1]).all()


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in page_text.main_texts(rows).collect()}
    pages = rows.collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"(?s)<article>(.*)</article>", p["html"])[1]
        want = [" ".join(unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p["page_id"]]["text"] == "\n".join(x for x in want if x), p["page_id"]
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"]) and got[p["page_id"]]["url"] == p["url"]


LONG = "Some words of a real paragraph that goes on for quite a while so that it counts as text. " * 2

PAGE = f"""<html><head><title>T</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body>
<header><a href=/>Site</a> <p>The site of sites</p></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for all of you who read it here.</div>
<main><article><header><h1>Head&amp;line &lt;1&gt;</h1></header><p title="a > b">{LONG}<p>Short.
<p>With <a href=x>a  link</a> in&nbsp;it &eacute;&#233; &amp; AT&T<br>next
<div class="ad-slot"><p>Buy this wonderful thing now and never regret it because it is so good.</p></div>
<p>{LONG}</p><aside><p>{LONG}</p></aside><form><label>Your name</label><input></form><!-- <p>hidden {LONG}</p> -->
<p class="share">Share this with all of your friends and family right now please.</p></article>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section></main>
<footer>&copy; 2024 Site</footer>"""


def test_parts_of_a_page():
    got = text(PAGE).split("\n")
    assert got == ["Head&line <1>", LONG.strip(), "Short.", "With a link in it éé & AT&T next", LONG.strip()]


def test_page_without_marks_and_broken_markup():
    page = f"<div><a>Home</a></div><div><a>News</a></div><div>A heading of it</div><div>{LONG}</div><div>{LONG}</div><div>tiny</div><div><a>Next</a> <a>page</a></div>"
    got = text(page).split("\n")
    assert got.count(LONG.strip()) == 2 and not {"Home", "News", "Next page"} & set(got)
    assert text(f"<article><p class='x\">{LONG}<p>{LONG}") != ""
    assert text("a < b and 3 <4 " + LONG) == ("a < b and 3 <4 " + LONG).strip()
    assert text("<article><p>x&am</p></article>") == "x&am" and text("<") == "" and text("<script>x") == ""


def test_edges(spark):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (None, "u", f"<article>{LONG}", "c"), (3, "u", "<article>" + "<p>w" * 50_000, "c"), (3, "u", "<" * 100_000, "c")]
    got = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and got[0]["text"] == "" and got[1]["text"] == "" and got[2]["text"] == LONG.strip()
    assert got[3]["text"] == "\n".join(["w"] * 50_000)
    assert page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def test_head_without_end_tag():
    for start in ("<head><title>t</title><body>", "<head><title>t</title><script>var a = '<p>no'</script>", "<head><style>p{}</style><meta charset=utf-8><link href=x>"):
        assert text(f"<html>{start}<article><p>real text</article>") == "real text"
    assert text("<head><title>never closed <article><p>x") == "" and text("<article><header><h1>x</h1></header></article>") == "x"


def test_self_closed_graphics_are_empty():
    for empty in ("<svg/>", '<svg class="a" />', "<math/>", "<svg><path d='M0 0'/><svg/><title/><style/></svg>"):
        assert text(f"<article><p>one</p>{empty}<p>two</p><svg><text>no</text></svg></article>") == "one\ntwo", empty
    assert text("<article><p>one<svg class=a/><text>no</text></svg> two</article>") == "one two"  # the slash is the attribute's
    assert text("<article><p>one<video/>no</video> two<svg-icon></svg-icon></article>") == "one two"


def test_unseen_elements_end_where_browsers_end_them():
    assert text("<article><div><button>no</div><p>one<svg><g>no<p>two<svg>no</p><p>three</article>") == "one\ntwo\nthree"
    assert text("<article><p>one<svg>no<svg>no</svg>no<foreignObject><p>no</p></foreignObject>no</svg><p>two</article>") == "one\ntwo"
    assert text("<article><template><div>no</article></div><p>no</template><p>one<select><option>no<p>no</div></select><p>two</article>") == "one\ntwo"
    assert text("<article><p>one<select><option>no<input><p>two<object>no<object>no</object>no</object><p>three</article>") == "one\ntwo\nthree"
    for many in ("<template>" + "<div>" * 50_000 + "</section>" * 50_000, "<svg>" * 50_000 + "</p>", "<template>" * 50_000 + "</div>" * 50_000):
        assert text(f"<article><p>one{many}") == "one"


MENU = "<ul class='menu'><li><a>One</a><li><a>Two</a></ul>"
BODY = f"<h1>Head</h1><p>{LONG}<h2 id='search-and-navigation'>Search</h2><p id='notice'>{LONG}<h2 id='discussion'>Discussion</h2><p>Short."
WANT = ["Head", LONG.strip(), "Search", LONG.strip(), "Discussion", "Short."]


def test_states_and_wrappers_do_not_mark_the_article():
    for page in (
        "<html class='no-share has-menu'><body class='single has-sidebar'>{}<article>{}</article>",
        "<body id='comments'>{}<article class='post comments-open'>{}</article>",
        "<body>{}<main class='has-sidebar share' id='search'>{}</main>",
        "<body><form id=form1>{}<article>{}</article></form>",
        "<body><form id=form1>{}<div>{}</div></form>",
        "<body><div class='layout sidebar'>{}<main>{}</main></div>",
        "<body><div class='comments-open'>{}<article class='comment'>{}</article></div>",
        "<body><div class='layout sidebar'><form>{}<main><article>{}</article></main></form></div>",
    ):
        got = text(page.format(MENU, BODY)).split("\n")
        assert got == WANT if "<div>" not in page else {*WANT} - {"Head", "Search", "Discussion", "Short."} <= {*got} and "One" not in got, page


def test_nothing_of_an_article_is_dropped_for_its_links_or_a_word_of_its_class():
    whole = (
        "<p><a href=x>Read the complete report on this site</a></p>", "<p class='byline'>By A. Writer</p>", "<p class='share-price'>The price rose.</p>",
        "<div class='search-history'><p>Searching began in caves.</p></div>", "<ul><li><a>Source one</a></li><li><a>Source two</a></li></ul>",
        "<p class='comment-culture'>People comment.</p>", "<section class='social-history'><p>Society then.</p></section>", "<p class='adTech'>On adverts.</p>",
    )
    gone = (
        "<ol class='thread'><li>A reader says no.</li></ol>", "<div class='share-bar'><a>Tweet</a></div>", "<div class='ad-slot-3'>Buy now.</div>", "<ul class='related-articles'><li><a>Other</a></ul>",
        "<div class='newsletterSignup'>Get our letters.</div>", "<p class='post-meta'>Posted in News</p>", "<div class='comment-list'>First!</div>", "<nav><a>Home</a></nav>",
    )
    plain = lambda html: [" ".join(re.sub("<[^>]*>", " ", x).split()) for x in re.split("</(?:p|li)>", html) if re.sub("<[^>]*>", "", x).strip()]
    want = [x for w in whole for x in [*plain(w), LONG.strip()]]
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='wrapper'><article class='post'>", "</article></div>")):
        assert text(start + "".join(w + f"<p>{LONG}</p>" + g for w, g in zip(whole, gone)) + end).split("\n") == want
        for w in whole:
            assert text(f"{start}{w}{end}").split("\n") == plain(w), w


def test_short_page():
    assert text("<p>Hello world</p>") == "Hello world" and text("<html><body>Hi</body></html>") == "Hi" and text("<p><a>Go on</a></p>") == ""


def test_parts_that_stay_marked():
    card = f"<article class='card'><p>{LONG}</article>"
    for other in (
        f"<section id='comments'><article><p>{LONG}</article><main><p>{LONG}</main></section>",
        f"<div class='related'>{card}</div>",
        f"<aside>{card}</aside>",
        f"<div hidden>{card}</div><article style='display:none'><p>{LONG}</article>",
        f"<article class='comment'><p>{LONG}</article>",
        "<form><label>Your name</label><p>Write to us today.</p></form>",
        f"<p class='notice'>{LONG}</p><h2 class='share'>Share</h2>",
    ):
        for start, end in (("<body>", ""), ("<body class='has-sidebar'><form><div class='layout sidebar'>", "</div></form>")):
            assert text(f"{start}<article>{BODY}</article>{other}{end}").split("\n") == WANT, other
            assert text(f"{start}<article>{BODY}{other}</article>{end}").split("\n") == WANT, other
