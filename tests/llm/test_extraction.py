import html as entities
import re

import pytest

from opsmill.llm import extraction as ex
from opsmill.llm.common import table


def page(title, paragraphs, extra="", menu=3):
    items = "".join(f"<li><a href='/{k}'>{title[:3]}{k}</a></li>" for k in range(menu))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body><nav><ul>{items}</ul></nav><!-- x --><article><h1>{title}</h1>{body}{extra}</article><footer>&copy; {title}</footer></body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, wrapper string").repartition(3)


def test_parts_that_go():
    extra = (
        "<aside>side</aside><form><p>mail?</p><input></form><div class='comments'><p>first!</p></div>"
        "<div class='ad-box ad'>buy</div><div id=cookie-notice>cookies</div><style>p{}</style>"
    )
    html = page("A &amp; B", ["one\n  <b>two</b>&nbsp;three", "<i></i>", "four<br>five &am six &quot;x&quot;"], extra)
    assert ex.main_text(html, None) == 'A & B\n\none two three\n\nfour five &am six "x"'


def test_unclosed_tags():
    html = "<body><article><h1>T<p><b>One.<br><p>Two <div>three</div> four<ul><li>x<li>y</ul><table><tr><td>a<td>b</table>"
    assert ex.main_text(html, None).split("\n\n") == ["T", "One.", "Two", "three", "four", "x", "y", "a", "b"]
    assert ex.main_text("a < b <c", None) == "a < b"
    assert ex.main_text("<script>never closed <p>x</p>", None) == ""


def test_alignment_finds_groups_options_and_slots():
    one = ex.expression(ex.tree(page("One", ["a", "b", "c"], menu=2)))
    two = ex.expression(ex.tree(page("Two", ["d"], "<div class=note>n</div>", menu=5)))
    both = ex._merged(one, two)
    found = dict(ex._walk(both, ()))
    article = ("html", "body", "article")
    assert found[(*article, "p")].often == "+" and found[(*article, "div note")].often == "?"
    assert found[(*article, "h1")].parts[0].text is None
    assert ex.rules(both) == {"roots": [article], "template": []}
    assert ex.unpacked(both.packed()).packed() == both.packed()


def test_template_texts_without_an_article(spark):
    make = lambda k: f"<body><div class=top>Site name</div><div class=body><p>Read on</p><p>Text {k} is long.</p><p>More of {k}.</p></div>"
    rows = [(k, "http://h.example/", make(k)) for k in range(12)]
    found = {r.page_id: r.text for r in ex.extract(pages(spark, rows)).collect()}
    assert all(f"Text {k} is long.\n\nMore of {k}." in found[k] and "Site name" not in found[k] for k in range(12))


def test_all_pages(spark, monkeypatch):
    monkeypatch.setattr(ex, "HOSTS_HELD", 3)
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k}'}.example/{k}", page(f"T{k}", [f"p{n} of {k}" for n in range(k % 5)])) for k in range(200)]
    rows += [(300, None, rows[1][2]), (301, "odd", None), (302, "http://hot.example/x", ""), (303, "http://hot.example/", "plain"), (None, "u", rows[2][2]), rows[4]]
    rows.append((304, "http://hot.example/long", page("L", ["word " * 50_000])))
    found = ex.extract(pages(spark, rows)).collect()
    assert len(found) == len(rows)
    want = {}
    for i, _, html in rows:
        parts = re.search(r"<article>(.*)</article>", html or "", re.S)
        texts = [" ".join(entities.unescape(t).split()) for t in re.findall(r"<(?:h1|p)>(.*?)</", parts[1], re.S)] if parts else []
        want[i] = "\n\n".join(texts)
    want[303] = "plain"
    assert {r.page_id: r.text for r in found} == want
    assert ex.extract(pages(spark, [])).collect() == []


@pytest.mark.parametrize("size", ["sf0.01"])
def test_given_pages(spark, size):
    texts = {r.page_id: r.text for r in ex.op5(spark, f"/root/testdata/{size}").collect()}
    for r in table(spark, f"/root/testdata/{size}", "pages").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (re.sub(r"<[^>]*>", " ", p) for p in re.split(r"</?p>|</?h1>", article))
        assert texts[r.page_id] == "\n\n".join(t for p in parts if (t := " ".join(entities.unescape(p).split())))


def test_texts_of_one_page_are_no_template(spark):
    """Pages without an article: one on its own host, and two of which one has more."""
    body = "<html><body><div class=body><h1>{}</h1><p>{}</p><p>{}</p>{}</div></body></html>"
    rows = [
        (1, "http://one.example/", body.format("T", "a", "b", "")),
        (2, "http://two.example/1", body.format("U", "c", "d", "")),
        (3, "http://two.example/2", body.format("V", "e", "f", "<blockquote>q</blockquote><p>g</p>")),
    ]
    assert ex.main_text(rows[0][2], None) == "T\n\na\n\nb"
    found = {r.page_id: r.text.split("\n\n") for r in ex.extract(pages(spark, rows)).collect()}
    assert found == {1: ["T", "a", "b"], 2: ["U", "c", "d"], 3: ["V", "e", "f", "q", "g"]}


@pytest.mark.parametrize("words", ["content has-sidebar", "no-sidebar wrap", "comments-open post", "page header-fixed"])
def test_layout_words_drop_nothing(words):
    for tag in ("article", "div"):
        html = f"<body><div class='{words}'><{tag}><h1>T</h1><p>a</p><p>b</p></{tag}></div><div class=sidebar><p>s</p></div>"
        assert ex.main_text(html, None) == "T\n\na\n\nb"


def test_elements_that_hold_the_article_stay():
    text = "<h1>T</h1><p>a</p><p>b</p><p>c</p>"
    aside = "<aside>x</aside><div class=sidebar><p>s</p></div>"
    assert ex.main_text(f"<body><div class=widget><article>{text}</article></div>{aside}", None) == "T\n\na\n\nb\n\nc"
    assert ex.main_text(f"<body><form><main>{text}</main></form>{aside}", None) == "T\n\na\n\nb\n\nc"
    assert ex.main_text(f"<body><div class=widget>{text}</div>{aside}", None) == "T\n\na\n\nb\n\nc"


def test_elements_left_open(spark):
    """5,000 nested elements, twice on one host, so that they are merged as well."""
    rows = [(k, "http://deep.example/", f"<body><h1>T{k}</h1>" + "<font>" * 5000 + f"<p>a{k}</p><p>b</p>") for k in range(2)]
    both = ex._merged(*(ex.expression(ex.tree(html)) for _, _, html in rows))
    assert ex.unpacked(both.packed()).packed() == both.packed()
    assert ex.main_text(rows[0][2], ex.rules(both)).startswith("T0")
    found = {r.page_id: r.text for r in ex.extract(pages(spark, rows)).collect()}
    assert set(found) == {0, 1} and all(f"a{k}" in found[k] for k in found)
