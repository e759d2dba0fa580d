"""Parts of a page that are no article, by structure and by names that no list has."""

import time

import pytest

from passageloom.llm.html_text import main_text

BODY = "<p>The first paragraph, of the article, has some words in it.</p><p>The second one, too, goes on for a while, and ends here.</p>"
READ = "The first paragraph, of the article, has some words in it.\nThe second one, too, goes on for a while, and ends here."
SAID = "I liked this very much, thank you, and I will read it again, with my friends, when it rains."
EACH = {
    "class": "<div class=zq-item><span class=author>Ann</span><p>{}</p></div>",
    "time": "<li class=zq><time>today</time><p>{}</p></li>",
    "rel": '<section class=row><a rel="author" href=/u/1>Bo</a><p>{}</p></section>',
    "avatar": '<div class=b><img class=x src=a.png><i class="user-name">Cy</i>{}</div>',
    "ago": "<div class=unit><p>3 days ago</p><p>{}</p></div>",
    "date": "<div class=unit><div>12. März 2021</div><p>{}</p></div>",
    "says": "<div class=unit><p>Dora says:</p><p>{}</p></div>",
    "nested": "<article class=u><b itemprop=author>Ed</b><p>{}</p></article>",
}
HEADS = ["<h2>Comments</h2>", "<h3>3 responses</h3>", "<h2>What readers say</h2><h3>Newest first</h3>", ""]


@pytest.mark.parametrize("each", EACH)
@pytest.mark.parametrize("head", HEADS)
def test_what_readers_said(each, head):
    said = "".join(EACH[each].format(f"{SAID} {k}.") for k in range(4))
    said = f"<ol class=zz>{said}</ol>" if each == "time" else f"<div class=zz>{said}</div>"
    for page in (f"<article>{BODY}{head}{said}</article>", f"<main>{BODY}</main>{head}{said}", f"<main><article>{BODY}</article>{head}{said}</main>", f"<article>{BODY}{said}<p>After all, a last word, of the writer.</p></article>"):
        want = READ + ("\nAfter all, a last word, of the writer." if "After" in page else "")
        if each == "nested" and "<article>" not in page or each in ("time", "date") and "After" in page:
            continue  # a date alone tells nothing within a text
        assert main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}</body></html>") == want


@pytest.mark.parametrize("part", [
    '<div class="discussion"><p>A thought, of a reader, on this.</p></div>', '<div class="user-reviews"><p>Five stars, of five, by Ann.</p></div>', '<section id="reader-feedback"><p>Some words, sent in, by many.</p></section>',
    '<div class="cookiebar"><p>We use cookies, as others do.</p></div>', '<div class="adbox"><p>Buy now, or never, at half price.</p></div>', '<div class="adslot-3"><p>Buy now, or never.</p></div>', '<div class="copyright">2020, all rights reserved.</div>',
    '<div class="tags">one, two, three</div>', '<div class="author-bio"><p>Ann writes, and reads, a lot.</p></div>', '<div class="sharedaddy"><p>Share this, if you like it.</p></div>', '<div style="display:none"><p>Not shown, to anyone, at all.</p></div>',
    '<div style="color: red; visibility : hidden"><p>Not shown, to anyone.</p></div>', "<div hidden><p>Not shown, to anyone.</p></div>", '<div class="commentary-box"><p>What one, or two, have said.</p></div>', '<div class="newsletterbox"><p>Sign up, it costs nothing.</p></div>',
    '<div class="subscribe-now"><p>Sign up, it costs nothing.</p></div>', '<div class="breadcrumbs2">Home, News, This</div>', '<div class="sponsoredby"><p>Paid for, by someone, today.</p></div>',
    '<div class="col-right"><p>Side text, of few words, here.</p></div>', '<div class="rail"><p>Side text, of few words.</p></div>', '<div id="secondary"><h3>Side</h3><p>Side text, of few words.</p></div>',
    "<form><p>" + "Tell us, please, what you think of this page. " * 9 + "</p><label>Name</label><input></form>", "<form><label>Your name, and address</label><input><button>Send</button></form>",
])
def test_what_stands_beside(part):
    for n in (1, 8):
        body, read = BODY * n, "\n".join([READ] * n)
        for page in (f"<article>{body}{part}</article>", f"<main>{body}</main>{part}", f"{part}<article>{body}</article>", f"<div class=col-left>{body}</div>{part}", f"<main><div>{body}</div>{part}</main>"):
            assert main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}</body></html>") == read


def test_a_side_column_that_comes_first():
    assert main_text(f'<body><div class="col-left"><p>Side text, of few words.</p></div><div class="col-right">{BODY}</div></body>').endswith(READ)
    assert main_text(f'<body><div class="left rail"><p>Side text, of few words.</p></div><div class="center">{BODY}</div></body>') == READ


@pytest.mark.parametrize("part, text", [
    ("<p>The <label>word</label> stays.</p>", "The word stays."), ("<p>A <span style='color:red'>red</span> word.</p>", "A red word."), ("<p>A <span style='display:none'>hidden </span>word.</p>", "A word."),
    ("<ul><li><a href='#a'>One</a></li><li><a href=\"#b\">Two</a></li></ul>", "One\nTwo"), ("<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul>", ""), ("<blockquote><p>As they said, long ago.</p></blockquote>", "As they said, long ago."),
    ("<p>By Ann, <time>3 May 2020</time></p>", "By Ann, 3 May 2020"), ("<h2>Part</h2><p>More of it.</p>", "Part\nMore of it."), ("<h2>Part</h2><div class=ad>Buy.</div><p>More of it.</p>", "Part\nMore of it."), ("<h2>Part</h2><div class=ad>Buy.</div><h3>Within</h3><p>More.</p>", "Part\nWithin\nMore."),
    ("<ul><li>May 3, 2020: founded.</li><li>May 4, 2021: closed.</li></ul>", "May 3, 2020: founded.\nMay 4, 2021: closed."),
    ("<div><div><time>2020</time><p>Founded.</p></div><div><time>2021</time><p>Closed.</p></div></div><p>So it was.</p>", "2020\nFounded.\n2021\nClosed.\nSo it was."),
    ("<table><tr><td>1 May 2020</td><td>12</td></tr></table>", "1 May 2020\n12"),
])
def test_what_belongs_to_it(part, text):
    for page in (f"<article>{BODY}{part}</article>", f"<html><body><nav><a href=/>Home</a></nav><main>{BODY}{part}</main></body></html>"):
        assert main_text(page) == READ + ("\n" + text if text else "")


def test_forms_around_an_article():
    for page in (f"<form action=/x><article>{BODY}</article><input></form><p>Imprint, and so on.</p>", f"<form><h1>Head</h1>{BODY}</form><p>Imprint.</p>", f"<form><div>{BODY}</div><label>Search</label><input></form>"):
        assert READ in main_text(f"<html><body>{page}</body></html>") and "Search" not in main_text(page)


def test_an_index_of_signed_posts_is_not_emptied():
    posts = "".join(f"<div class=post><span class=author>Ann</span>{BODY}</div>" for _ in range(3))
    assert main_text(f"<body><div>{posts}</div></body>").count(READ) == 3


def test_time_in_proportion():
    def took(n):
        page = "<article>" + BODY + "".join(EACH["class"].format(SAID) + "<h2>x</h2><form><p>a, b</p></form>" for _ in range(n)) + "</article>"
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    took(100)
    assert took(8000) < 6 * took(2000) + 0.2
