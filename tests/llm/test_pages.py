"""Operators on web pages."""

import hashlib
import re
from urllib.parse import urlsplit

import pytest

from posttrain_spark.llm import html_text, warc
from posttrain_spark.session import scratch_path

SCHEMA = "page_id long, url string, html string, text string, path string, digest string"
ARTICLE = "<p>First <b>words</b> &amp; more&nbsp;here.<p>Second<br>line<ul><li>one<li>two</ul>"


def page(body, top=""):
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'>{top}"
        f"<nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use</div>{body}"
        "<div class='comments'><p>I disagree</p></div><footer>&copy; x</footer><script>var a='<p>no</p>'</script>"
    )


@pytest.fixture(scope="module")
def rows():
    def row(i, url, html):
        return (i, url, html, "clash", "p", "d")

    whole = page(f"<article>{ARTICLE}</article>")
    out = [row(i, f"http://www.Host{i % 2}.org/a/{i}?x={i}", page(f"<div class='post-{i}'>{ARTICLE}</div>")) for i in range(8)]
    out += [row(20, "http://c.org/", whole), row(19, "http://c.org/", whole), row(None, "http://c.org/z", whole)]
    out += [row(21, None, whole), row(22, "", None), row(23, "not a url", ""), row(24, "http://e.org/\tx", "a < b")]
    out += [row(20, "http://c.org/", whole), row(25, "http://f.org", "x" * 99), row(26, "http://f.org", "x" * 99)]
    out += [row(27, "http://g.org", "<p>" + "long é " * 50_000), row(None, "http://h.org", "z" * 100)]
    return out


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_main_text(pages, rows, spark):
    got = {(r["page_id"], r["url"]): r for r in html_text.main_text(pages).collect()}
    want = "First words & more here.\n\nSecond line\n\none\n\ntwo"
    for i in range(8):
        assert got[i, f"http://www.Host{i % 2}.org/a/{i}?x={i}"]["text"] == want
    assert got[20, "http://c.org/"]["text"] == got[21, None]["text"] == want
    assert (got[22, ""]["text"], got[23, "not a url"]["n_chars"]) == ("", 0)
    assert got[24, "http://e.org/\tx"]["text"] == "a < b"
    assert got[27, "http://g.org"]["n_chars"] == 50_000 * 7 - 1
    assert html_text.main_text(pages).count() == len(rows)
    assert html_text.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a<b", "a"),
        ("x<!-- open", "x"),
        ("<div><p>a</div>b", "a\n\nb"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<article><header><h1>T</h1></header>b<aside>no</aside></article>", "T\n\nb"),
        ("<p>I <span hidden>no</span>am<form><input>no</form>", "I am"),
        ("<main><p>a &lt;b&gt; &#233;</p></main><section class='related'>no</section>", "a <b> é"),
    ],
)
def test_html(html, text):
    assert html_text.Page(html).text_at(None) == text


def test_unmarked_boilerplate_of_a_host(spark):
    """Menus, footers and link lists without telling names go; articles stay, also where pages are copies."""
    import random

    rng = random.Random(2)

    def story():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))

    def html(text, i, links):
        more = "".join(f"<a href='/{k}'>{story()[:9]}</a> " for k in range(links))
        return (
            f"<body><div class='top'>Home About</div><div class='x1'><h1>On {i}</h1><p>{text}</p><h2>Sources</h2><p>{text[:30]}</p></div>"
            f"<div class='y'>{more}</div><div class='bottom'>Next story {i} of 9</div>"
        )

    stories = [story() for _ in range(6)]
    rows = [(i, f"http://s.org/{i}", html(s, i, 4)) for i, s in enumerate(stories)]
    # Copies of one article with other menus: nothing in it may be taken for boilerplate.
    rows += [(10 + i, f"http://copy.org/{i}", f"<body><div class='m'>{story()}</div><div class='a'><p>{stories[0] * 3}</p><h3>End</h3></div>") for i in range(5)]
    # Two pages are too few to tell.
    rows += [(20 + i, f"http://few.org/{i}", html(s, i, 0)) for i, s in enumerate(stories[:2])]
    table = [(*r, "", "", "") for r in rows]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(table, SCHEMA)).collect()}
    for i, s in enumerate(stories):
        assert got[i] == f"On {i}\n\n{s}\n\nSources\n\n{s[:30].strip()}"
    for i in range(5):
        assert stories[0] * 3 in got[10 + i] and got[10 + i].endswith("End")
    assert "Home About" in got[20]


def test_boilerplate_votes_against_brute_force(spark):
    """Counted anew in plain Python from the pages' own blocks."""
    import random

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for i in range(40):
        host = rng.choice("abc")
        parts = "".join(f"<div class='{rng.choice('pqrs')}'>{' '.join(rng.choice(words) for _ in range(rng.choice((1, 2, 30))))}</div>" for _ in range(5))
        rows.append((i, f"http://{host}.org/{i}", f"<div class='k'>Same {i}</div><div class='l'><a href='x'>{rng.choice(words)}</a></div>{parts}", "", "", ""))
    seen, mains = {}, {}
    for _, url, html, *_ in rows:
        host, page = url.split("/")[2], html_text.Page(html)
        main, paths = page.block_paths()
        mains.setdefault(host, set()).add(main)
        for path, blocks in paths.items():
            said = re.sub(r"\d+", "0", "\n\n".join(page.texts[i] for i in blocks))
            sizes = sum(len(page.texts[i]) for i in blocks), sum(page.links[i] for i in blocks), sum(map(len, page.texts))
            seen.setdefault((host, path), {}).setdefault((main, said), sizes)
    want = set()
    for (host, path), found in seen.items():
        sizes = [sum(v[k] for v in found.values()) for k in range(3)]
        same = max(sum(said == other for _, other in found) for _, said in found)
        half = len(mains[host]) / 2
        if len(found) >= 3 and len(found) > half and sizes[0] < 0.3 * sizes[2]:
            if same >= 3 and same > half or sizes[1] >= 0.8 * sizes[0]:
                want.add((host, path))
    votes = html_text.page_votes(spark.createDataFrame(rows, SCHEMA))
    got = {(r["host"], p) for r in html_text.boilerplate_paths(votes).collect() for p in r["dropped"]}
    assert got == want and want


def test_a_host_outvotes_a_page(spark):
    usual = "<body><div class='body'>" + "<p>story text</p>" * 5 + "</div><div class='extra'>{}</div></body>"
    rows = [(i, f"http://h.org/{i}", usual.format("<p>short</p>"), "", "", "") for i in range(5)]
    rows.append((9, "http://h.org/9", usual.format("<p>very much other text</p>" * 30), "", "", ""))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9] == got[0] == "\n\n".join(["story text"] * 5)


@pytest.mark.parametrize("tag", ["div", "ul", "pre", "table", "blockquote"])
def test_heading_and_lead_beside_a_large_part(tag):
    html = page(f"<div class='post'><h1>Head</h1><p>Lead</p><{tag}>{'long story ' * 40}</{tag}></div>")
    assert html_text.Page(html).text_at(None) == "Head\n\nLead\n\n" + ("long story " * 40).strip()


@pytest.fixture(scope="module")
def archive(spark, pages):
    return warc.write_archives(pages, scratch_path(spark, "archive"))


def test_archives_read_back(archive, rows):
    got = warc.with_referred_sizes(warc.read_captures(archive)).collect()
    first = {}
    for r in rows:
        payload = (r[2] or "").encode()
        if len(payload) >= 100 and r[0] is not None:
            first[payload] = min(r[0], first.get(payload, r[0]))
    want = []
    for r in rows:
        payload = (r[2] or "").encode()
        head = first.get(payload)
        later = head is not None and (r[0] is None or r[0] > head)
        want.append((r[0], len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if later else "response", head if later else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)


def test_lookup(spark, archive, rows, monkeypatch):
    asked = ["http://c.org/", "http://www.host1.org/a/3?x=3", "http://nowhere.org/", None]
    got = warc.lookup(archive, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    keys = {warc.url_key(u) for u in asked}
    want = [r[0] for r in rows if warc.url_key(r[1]) in keys]
    assert sorted((r["page_id"] for r in got), key=str) == sorted(want, key=str)
    assert all(bytes(r["payload"]).decode() == next(x[2] or "" for x in rows if x[0] == r["page_id"]) for r in got if r["payload"] is not None)


def test_lookup_across_blocks(spark, pages, rows, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    small = warc.write_archives(pages, scratch_path(spark, "archive"))
    got = warc.lookup(small, pages.select("url")).count()
    assert got == len(rows)


def test_no_pages(spark):
    nothing = warc.write_archives(spark.createDataFrame([], SCHEMA), scratch_path(spark, "archive"))
    assert warc.with_referred_sizes(warc.read_captures(nothing)).collect() == []
    assert warc.lookup(nothing, spark.createDataFrame([("http://a.org/",)], "url string")).collect() == []


def test_keys_and_records():
    assert warc.url_key("HTTP://A.b.org:81/x?y#z") == "org,b,a:81)/x?y"
    assert warc.url_key("http://[::1") == warc.url_key(None) == warc.url_key("plain") == ""
    assert urlsplit("http://a").hostname == "a"
    data = warc.record(3, "http://a\r\nX: y", b"\r\n\r\nbody", "00", None, "d")
    headers, body = warc.parse(data)
    assert body == b"\r\n\r\nbody" and headers["warc-target-uri"] == "http://a%0D%0AX: y"
    with pytest.raises(ValueError):
        warc.parse(data[:-1])
