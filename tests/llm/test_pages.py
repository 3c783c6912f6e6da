"""Whole pages written by hand, in layouts of many kinds of sites, each with its exact article."""

import pytest

from inflecta.llm import html_crf

A1 = "The old bridge over the river was closed on Monday after engineers found cracks in two of its pillars."
A2 = "Residents now have to take the longer road through the valley, which adds about twenty minutes to the trip."
A3 = "The council said that repairs would begin in spring, and that a ferry might run for the summer months."
ART = [A1, A2, A3]
PARAS = "".join(f"<p>{t}</p>" for t in ART)
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/contact">Contact</a></li></ul>'
FOOT = "<p>&copy; 2024 Valley Gazette. All rights reserved.</p>"


def document(body: str, head: str = "<title>Bridge closed - Valley Gazette</title>") -> str:
    return f"<!doctype html><html lang=en><head>{head}</head><body>{body}</body></html>"


def wrapped(n: int, inner: str, attributes: str = "") -> str:
    return f"<div{attributes}>" * n + inner + "</div>" * n


PLAIN = f"<nav>{MENU}</nav><article><h1>Bridge closed</h1>{PARAS}</article><footer>{FOOT}</footer>"
HEADED = ["Bridge closed", *ART]
COMMENTS = '<div id="comments"><h3>2 Comments</h3><ol class="commentlist"><li><div class="comment-body"><p>I used that bridge every day for thirty years, what a shame that is.</p></div></li><li><div class="comment-body"><p>They should have repaired it long ago, if you ask me about it.</p></div></li></ol></div>'

PAGES = {
    **{f"plain in {n} divs": (document(wrapped(n, PLAIN)), HEADED) for n in (0, 1, 2, 3, 4, 6, 10, 30, 100)},
    "unnamed divs": (document(f"<div class=x1><div class=x2>{MENU}</div><div class=x3><h1>Bridge closed</h1>{PARAS}</div><div class=x4>{FOOT}</div></div>"), HEADED),
    "divs without names": (document(f"<div><div>{MENU}</div><div><h1>Bridge closed</h1>{PARAS}</div><div>{FOOT}</div></div>"), HEADED),
    "hashed names": (document(f'<div class="css-1q2w3e"><div class="css-9z8y">{MENU}</div><div class="css-aa11b"><div class="css-77f"><h1 class="css-k">Bridge closed</h1>{PARAS}</div></div><div class="css-zz">{FOOT}</div></div>'), HEADED),
    "blog": (
        document(
            f'<div id="page" class="hfeed site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Valley Gazette</a></p><p class="site-description">News from the valley since 1902</p></header>'
            f'<div id="primary" class="content-area"><div class="entry-content">{PARAS}<div class="sharedaddy sd-sharing-enabled"><h3>Share this:</h3><ul><li><a href="#">Click to share on Twitter</a></li><li><a href="#">Click to email this to a friend</a></li></ul></div></div></div>'
            f'<div id="secondary" class="widget-area sidebar"><h2>Recent posts</h2><ul><li><a href="/1">Harvest festival draws a crowd</a></li><li><a href="/2">School gets a new roof</a></li></ul><p>The gazette is printed each week and sold in every shop of the valley for two coins.</p></div>'
            f'<footer id="colophon" class="site-footer">{FOOT}</footer></div>'
        ),
        ART,
    ),
    "blog without sidebar": (document(f'<div id="page"><div id="primary"><div class="entry-content">{PARAS}</div><div class="sharedaddy"><p>Share this: <a href=#>Twitter</a> <a href=#>Email</a></p></div></div></div>'), ART),
    "blog with comments": (document(f'<div id=page class=site><div id=content class=site-content><main id=main><article class="post type-post"><header class=entry-header><h1 class=entry-title>Bridge closed</h1></header><div class=entry-content>{PARAS}</div></article>{COMMENTS}<div id=respond><h3>Leave a reply</h3><form><label>Name</label><input><textarea></textarea><button>Post comment</button></form></div></main></div></div>'), HEADED),
    "body names": (f'<html><body class="single-post has-sidebar comments-open nav-fixed footer-dark"><div class="wrapper with-sidebar no-banner">{PLAIN}</div></body></html>', HEADED),
    "table layout": (
        document(f'<table width=100%><tr><td colspan=2><b>Valley Gazette</b></td></tr><tr><td width=150 valign=top><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td><td><h1>Bridge closed</h1>{PARAS}</td></tr><tr><td colspan=2><small>&copy; 2024 Valley Gazette. All rights reserved.</small></td></tr></table>'),
        HEADED,
    ),
    "table layout with one menu cell": (document(f"<table><tr><td><a href=/a>A</a></td><td>{PARAS}</td></tr></table>"), ART),
    "grid": (document(f'<div class="container"><div class="row"><div class="col-md-8"><h1>Bridge closed</h1>{PARAS}</div><div class="col-md-4"><div class="card"><div class="card-header">Most read</div><ul class="list-group"><li><a href=/1>Harvest festival draws a crowd</a></li><li><a href=/2>School gets a new roof</a></li><li><a href=/3>Mayor opens new library</a></li></ul></div></div></div></div><footer class="py-5 bg-dark"><div class="container"><p class="m-0 text-center">Copyright &copy; Valley Gazette 2024</p></div></footer>'), HEADED),
    "news": (
        document(
            f'<div id="cookie-banner" role="dialog"><p>We use cookies to make this site work and to show you adverts that suit you.</p><button>Accept all</button></div><a class="skip-link" href="#main">Skip to main content</a><div class="topBar"><div class="leftMenu">{MENU}</div></div>'
            f'<main id="main"><div class="story-body"><h1>Bridge closed</h1><p>{A1}</p><div class="advert-slot"><span>Advertisement</span></div><p>{A2}</p><aside class="newsletter-signup"><h4>Get our newsletter</h4><p>Sign up and we will send you the best stories each morning.</p></aside><p>{A3}</p></div>'
            f'<div class="relatedStories"><h2>More on this story</h2><ul><li><a href=/1>Harvest festival draws a crowd</a></li><li><a href=/2>School gets a new roof</a></li></ul></div></main><div class="pageFooter"><a href=/terms>Terms of use</a> | <a href=/privacy>Privacy policy</a> | <a href=/help>Help</a></div>'
        ),
        HEADED,
    ),
    "encyclopedia": (
        document(
            f'<div id="mw-navigation"><h2>Navigation menu</h2><div id="p-navigation" class="portal" role="navigation"><h3>Navigation</h3><ul><li><a href=/m>Main page</a></li><li><a href=/r>Random article</a></li></ul></div></div>'
            f'<div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">Bridge closed</h1><div id="bodyContent" class="mw-body-content"><div id="mw-content-text" class="mw-content-ltr"><div class="mw-parser-output"><p>{A1}</p><h2>Detour</h2><p>{A2}</p><p>{A3}</p></div></div></div></div>'
            f'<div id="footer" role="contentinfo"><ul id="footer-info"><li>This page was last edited on 3 March 2024.</li><li>Text is available under a free licence; other terms may apply.</li></ul></div>'
        ),
        ["Bridge closed", A1, "Detour", A2, A3],
    ),
    "documentation": (document(f'<div class="related" role="navigation"><h3>Navigation</h3><ul><li><a href=n>next</a></li><li><a href=p>previous</a></li></ul></div><div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section><h1>Bridge closed</h1>{PARAS}</section></div></div></div><div class="sphinxsidebar" role="navigation"><div class="sphinxsidebarwrapper"><h3>Table of contents</h3><ul><li><a href=a>Install</a></li><li><a href=b>Usage</a></li></ul></div></div></div><div class="footer">&copy; Copyright 2024, the authors.</div>'), HEADED),
    "no container": (document(f"<h1>Bridge closed</h1>{PARAS}"), HEADED),
    "old page": ("<HTML><BODY BGCOLOR=white><CENTER><A HREF=/>Home</A> | <A HREF=/n>News</A> | <A HREF=/s>Sport</A></CENTER><HR><H1>Bridge closed</H1>" + "".join(f"<P>{t}" for t in ART) + "<HR><FONT SIZE=1>Copyright 1998 Valley Gazette. All rights reserved.</FONT></BODY></HTML>", HEADED),
    "apostrophe in a value": (document(f"<nav>{MENU}</nav><article><p title=don't>{A1}</p><p>{A2}</p><p>It's fine: {A3}</p></article>"), [A1, A2, f"It's fine: {A3}"]),
    "quote that never ends": (document(f'<article><p title="x>{A1}</p><p>{A2}</p><p>{A3}</p></article>'), ART),
    "script with a slash": (document(f"<article><script src=x />var a=1; document.write('<p>no</p>');</script>{PARAS}</article>"), ART),
    "script in script": (document(f'<article><script>if (a < b) document.write("<p>x</p>")</script >{PARAS}<style media=print/>p{{}}</style></article>'), ART),
    "hidden": (document(f'<nav>{MENU}</nav><article><p hidden>Some hidden text that no reader of the page would ever see at all.</p><h1>Bridge closed</h1>{PARAS}<p style="color:red; display: none">Another hidden text that no reader of the page would ever see at all.</p><p>Short <span style="display:none">unseen</span>end.</p></article>'), [*HEADED, "Short end."]),
    "deep comments": (document(f"<article><h1>Bridge closed</h1>{PARAS}</article><div class=comments>" + wrapped(410, "<p>So I went there myself and saw it, and it was closed indeed.</p>") + "<p>I used that bridge every day for thirty years, what a shame that is.</p></div>"), HEADED),
    "list article": (document(f"<header><a href=/>Gazette</a></header><article><h1>Bridge closed</h1><p>{A1}</p><ul><li>Take the north road.</li><li>Or walk.</li></ul><blockquote><p>{A2}</p></blockquote><pre>a  b\nc</pre><table><tr><th>Day</th><th>Cars</th></tr><tr><td>Monday</td><td>12</td></tr></table><p>{A3}</p></article><footer>{FOOT}</footer>"), ["Bridge closed", A1, "Take the north road.", "Or walk.", A2, "a b c", "Day", "Cars", "Monday", "12", A3]),
    "figure and link": (document(f'<div class="site-nav">{MENU}</div><main><h1>Bridge closed</h1><p>{A1}</p><figure><img src=a.jpg alt=x><figcaption>The bridge in 1990.</figcaption></figure><p>See <a href=/plan>the plan of the council</a> for more.</p><p>{A2}</p></main><div class="site-footer">{FOOT}</div>'), ["Bridge closed", A1, "The bridge in 1990.", "See the plan of the council for more.", A2]),
    "sidebar before": (document(f'<div class="wrap"><div id="leftSidebar"><h4>Archives</h4><ul><li><a href=/1>March 2024</a></li><li><a href=/2>April 2024</a></li></ul><p>This gazette has been read in the valley for more than a hundred years now.</p></div><div id="rightContent"><h2>Bridge closed</h2>{PARAS}</div></div>'), HEADED),
    "references": ("<article><p>Caf&eacute; &#8212; 5 &lt; 6 &amp;amp; &notin; &copy;2 &#x1F600; a&nbsp;b</p><p>x&ampy &unknown; &</p></article>", ["Café — 5 < 6 &amp; ∉ ©2 😀 a b", "x&y &unknown; &"]),
    "foreign furniture": (document(f'<nav><ul><li><a href=/>Startseite</a></li><li><a href=/k>Kontakt</a></li></ul></nav><div id="inhalt"><h1>Brücke gesperrt</h1><p>Die alte Brücke über den Fluss ist seit Montag gesperrt, weil zwei Pfeiler Risse zeigen.</p><p>Anwohner müssen nun die längere Straße durch das Tal nehmen, was zwanzig Minuten kostet.</p></div><footer>Impressum und Datenschutz</footer>'), ["Brücke gesperrt", "Die alte Brücke über den Fluss ist seit Montag gesperrt, weil zwei Pfeiler Risse zeigen.", "Anwohner müssen nun die längere Straße durch das Tal nehmen, was zwanzig Minuten kostet."]),
    "one paragraph": (document(f"<div><div><div><p>{A1}</p></div></div></div>"), [A1]),
    "social buttons": (document(f'<div class="l-page"><div class="l-main"><div class="post"><h1>Bridge closed</h1><div class="social-links"><a href=#>Facebook</a> <a href=#>Twitter</a></div>{PARAS}<div class="post-tags">Tags: <a href=/t>bridge</a>, <a href=/u>valley</a></div></div><div class="disqus_thread"><p>Please log in to read what others have written about this.</p></div></div></div>'), HEADED),
    "modal after": (document(f'<div class="app">{PLAIN}</div><div class="modal fade" role="dialog"><div class="modal-dialog"><h4>Subscribe now</h4><p>Read as many stories as you like for only one coin a week, and stop when you want.</p></div></div>'), HEADED),
    "furniture words": (document(f"<nav>{MENU}</nav><article><h1>Newsletter</h1><p>Home</p><p>{A1}</p><p>Subscribe to nothing.</p><p>{A2}</p></article><footer>{FOOT}</footer>"), ["Newsletter", "Home", A1, "Subscribe to nothing.", A2]),
}


@pytest.fixture(scope="module")
def crf():
    return html_crf.trained()


@pytest.mark.parametrize("name", PAGES)
def test_article_of_a_page(crf, name):
    page, lines = PAGES[name]
    assert crf.extract(page) == "\n".join(lines)


def test_pages_without_an_article(crf):
    assert crf.extract(document(f"<nav>{MENU}</nav><footer>{FOOT}</footer>")) == ""
    assert crf.extract("<script>var a = 1;") == "" and crf.extract("<!-- a -->") == ""
