import math
import random
import re
from collections import defaultdict

import pytest

from tracegauge.llm.htmltree import DAMP, branches, extract, importance, main_text, merged

CASES = [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<article><h1>T</h1><p>a <b>b</b>\n c<br>d</p></article>", "T\na b c d"),
    ("<body><nav><ul><li>x</li></ul></nav><article><p>a</p><aside>s</aside><footer>f</footer></article><footer>g</footer></body>", "a"),
    ("<script>var a='</p>';</script><style>p{}</style><p>x<!-- <p>no</p> --></p>", "x"), ("<div class='ad'>buy</div><div class=\"main-text\">keep</div>", "keep"),
    ("<header>h</header><main><p>m</p><form><input value='x'><button>go</button></form></main>", "m"), ("<p>un<p title='a>b'>z</p>", "un\nz"), ("<article><p><b>one<br><p>two</p></article>", "one\ntwo"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("&lt;b&gt; &eacute;&#233;&nbsp;x", "<b> éé x"), ("<div id=comments><p>c</p></div><div class='user comments'>d</div><p>e</p>", "e"),
    ("<title>t</title><p>x</p><noscript>n</noscript><textarea><p>q</p></textarea>", "x"), ("</p></div>a</b>", "a"), ("<article><p>a</p></article><div>out</div><article><p>b</p></article>", "a\nb"), ("<p>a</p" , "a"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_page(html, text):
    assert main_text(html) == text


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    from html import unescape

    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_repeated_branches_go(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    page = lambda: (f"<div><div class='tagline'><p>Welcome to our site</p></div><div class='body'><p>{words(20)}</p><p>Same line</p></div></div>")
    rows = [(i, "http://a.example/x", page(), "h") for i in range(40)] + [(100 + i, "http://b.example/", page(), "h") for i in range(3)] + [(200, None, None, "h"), (None, "x", "", "h"), (200, None, None, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)
    got = {r.page_id: r for r in extract(df).collect()}
    assert all("Welcome" not in got[i].text and "Same line" in got[i].text and len(got[i].text) > 100 for i in range(40))
    assert all("Welcome" in got[100 + i].text for i in range(3)) and got[200].text == "" and got[200].n_chars == 0
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0
    # exact copies are no evidence
    copies = spark.createDataFrame([(i, "http://c.example/", "<p>all the same</p>") for i in range(50)], "page_id long, url string, html string")
    assert {r.text for r in extract(copies).collect()} == {"all the same"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body class='home right-sidebar'><div><p>a</p></div></body>", "a"),
        ("<div class='no-comments'><p>a</p></div>", "a"),
        ("<article class='article-header'><p>a</p></article>", "a"),
        ("<article class='header'><p>a</p></article>", "a"),
        ("<div class='content with-ads'><article><p>a</p></article><div class='ads'>b</div></div>", "a"),
        ("<div class='promo'><article><p>a</p></article></div>", "a"),
        ('<p title="x>b', "b"),
        ('<p title="x>b</p><p class=\'y>c</p>', "b\nc"),
        ("<form><article><p>a</p></article></form><form>b</form>", "a"),
        ("<article>teaser</article><div>" + "<p>long body text</p>" * 5 + "</div>", "teaser\n" + "\n".join(["long body text"] * 5)),
        ("<div role='main' class='banner'><p>a</p></div><p>b</p>", "a"),
    ],
)
def test_roles_and_broken_tags(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 50_000 + "a" + "</div>" * 50_000) == "a"
    assert len(branches("<div>" * 50_000 + "a")) == 40
    assert main_text("<a '" * 50_000 + ">b") == "b"


def brute_importance(pages):
    """By a walk over each host's tree, from the same statements about pages as the module's docstring."""
    seen = defaultdict(dict)
    for host, html in {(h, p) for h, p in pages}:
        for path, (up, _, shown, said) in branches(html).items():
            at = seen[host].setdefault(path, (up, [], defaultdict(int)))
            at[1].append(shown)
            for x in said:
                at[2][x] += 1
    out = {}
    for host, nodes in seen.items():

        def value(path):
            _, shown, said = nodes[path]
            m = len(shown)
            log = lambda x: math.log(x, m + 1)
            look = 1.0 if m == 1 else -sum(n / m * log(n / m) for n in (shown.count(s) for s in set(shown)))
            parts = [(len(nodes[k][1]), *v) for k in nodes if nodes[k][0] == path and (v := value(k))]
            if said:
                parts.append((m, 1.0 if m == 1 else 1 - sum(log(n) for n in said.values()) / len(said), 0))
            if not parts:
                return None
            w = DAMP ** len(parts)
            own = w * sum(p[0] * p[1] for p in parts) / sum(p[0] for p in parts) + (1 - w) * look
            peak = max([own, *(p[2] for p in parts)])
            out[host, path] = (m, round(own, 9), round(peak, 9))
            return own, peak

        for path in nodes:
            if nodes[path][0] == 0:
                value(path)
    return out


def test_importance_of_small_hosts(spark):
    rng = random.Random(8)
    words = lambda: " ".join(rng.choice("one two three four".split()) for _ in range(2))
    page = lambda: f"<div class=top><p>Site</p><ul>{'<li>x' * rng.randrange(1, 3)}</ul></div><div><h1>{words()}</h1>{''.join(f'<p>{words()}</p>' for _ in range(rng.randrange(4)))}<img></div>"
    pages = [(rng.choice("abc"), page()) for _ in range(40)] + [("d", "<p>only</p>")] + [("e", "")]
    df = spark.createDataFrame([*pages, pages[0]], "host string, html string").repartition(3)
    got = {(r.host, r.branch): (r.pages, round(r.importance, 9), round(r.peak, 9)) for r in importance(merged(df)).collect()}
    assert got == brute_importance(pages) and len(got) > 20


def test_the_tree_decides(spark, monkeypatch):
    """Without low branches the site's line would stay; a page that has nothing else keeps it; other branches of the tables join."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    rows = [(i, "http://a.example/", f"<div class=strap><p>Made by us</p></div><div class=body><p>{word()}</p></div>") for i in range(12)]
    rows.append((50, "http://a.example/", "<div class=strap><p>Made by us</p></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert all(got[i] and "Made" not in got[i] for i in range(12)) and got[50] == "Made by us"
    assert all("Made by us" in main_text(html) for _, _, html in rows)
    monkeypatch.setattr("tracegauge.llm.htmltree.BROADCAST_ROWS", 0)
    assert {r.page_id: r.text for r in extract(df).collect()} == got


ARTICLE = "<h1>Title</h1><p>" + "some words of the story " * 5 + "</p>"
STORY = "Title\n" + " ".join(["some words of the story"] * 5)


@pytest.mark.parametrize(
    "html",
    [
        f"<div class='sidebar content'>{ARTICLE}</div><div class='sidebar'>more</div>",
        f"<div class='promotion'>{ARTICLE}</div>",
        f"<form action='/'><input name='q'><div>{ARTICLE}</div><button>go</button><select><option>a</select></form>",
        f"<div class='header-fixed'>{ARTICLE}</div>",
        f"<article>{ARTICLE}</article><section id='comments'><article class='comment'><p>{'I think so too. ' * 40}</p></article></section>",
        f"<div>{ARTICLE}</div><ol class='comment-list'><li>{'me too ' * 60}</li></ol>",
        f"<div>{ARTICLE}</div><div class='related-posts'><p>see this</p></div><div class='ad-slot'>buy</div><div id='cookie-banner'>we use them</div>",
        f"<div class='menu'>{'<a href=x>a link to it</a> ' * 40}</div><div>{ARTICLE}</div>",
        f"<nav>{'all our many pages ' * 40}</nav><div>{ARTICLE}</div>",
        f"<div class='promo-box'><article>{ARTICLE}</article></div><div class='share_bar'>tell</div>",
    ],
)
def test_names_are_a_prior_only(html):
    assert main_text(html) == STORY


def test_held_out_templates_need_the_tree(spark, monkeypatch):
    """Hosts whose menus, straps and footers bear no names that tell, and no article: what stays on four pages or more goes, the stories stay whole."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    line = lambda n: " ".join(word(rng.randrange(2, 9)) for _ in range(n))
    rows, want = [], {}
    for host in range(12):
        tags = rng.sample(["div", "section", "span", "td"], 3)
        top, strap, end = (f"<ul class='{word(4)}'>" + "".join(f"<li>{line(2)}</li>" for _ in range(4)) + "</ul>", f"<{tags[0]} class='{word(5)}'>{line(6)}</{tags[0]}>", f"<{tags[1]} id='{word(3)}'><p>{line(9)}</p></{tags[1]}>")
        kind = word(4)
        for k in range(rng.randrange(4, 12)):
            story = [line(rng.randrange(8, 30)) for _ in range(rng.randrange(1, 6))]
            i = 1000 * host + k
            rows.append((i, f"http://h{host}.example/{k}", f"<html><body>{top}{strap}<div class='{kind}'>{''.join(f'<p>{s}</p>' for s in story)}</div>{end}</body></html>"))
            want[i] = "\n".join(story)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == want
    bare = {r.page_id: r.text for r in extract(df, least=-1.0).collect()}
    assert all(len(bare[i]) > len(want[i]) for i in want)
