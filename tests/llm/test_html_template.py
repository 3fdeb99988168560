import html
import re

from tidepanel.llm import html_template as h

SCHEMA = "page_id long, url string, html string, text string"


def plain(page):
    """What the given pages hold, taken from their known layout."""
    body = page.split("<article>")[1].split("</article>")[0]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in blocks if x)


def test_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in h.extract(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_tags_with_stray_quotes_are_still_tags():
    assert h.main_text('<p class="x>hello</p><p>a < b > c</p>', set(), False) == "hello\na < b > c"
    assert h.main_text("<p title='>'>q</p><i class=\"", set(), False) == "q"


def site(i, body):
    return (
        f"<html><head><title>t{i}</title><script>if (a < b) '<p>x</p>'</script></head><body><header>Site</header>"
        f"<div id=top>Welcome to the site</div><nav><ul><li><a href=/x{i}>m{i}</a></ul></nav><main>{body}</main>"
        f"<div class='user-comments'><p>nice {i}</p></div><aside>more</aside><form><p>mail?</p></form><footer>&copy; us</footer>"
    )


def test_roles_blocks_and_references(spark):
    body = "<h1>A &lt;b&gt; &#8364;</h1>\n<p>one\n two <b>bold</b><i>er</i><p>three<br>four<!-- no <p>x</p> --><ul><li>i1<li>i2</ul><div class=ad>buy</div>tail &am"
    rows = [(i, f"http://h.example/{i}", site(i, body), "") for i in range(5)]
    got = h.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in got} == {"A <b> €\none two bolder\nthree four\ni1\ni2\ntail &am"}


def test_template_without_content_element(spark):
    """The template's own texts go although nothing marks them; slots stay."""
    page = "<html><body><div>Our site since 1990</div><div>{}</div><div>All rights kept</div></body></html>"
    rows = [(i, f"https://u@k.example:8/{i}", page.format(f"story number {i}"), "") for i in range(6)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {i: f"story number {i}" for i in range(6)}
    found = h.templates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 1 and found[0].n_pages == 6
    assert sorted((c["count"], c["pages"]) for c in found[0].classes)[-1] == (3, 6)  # <div> thrice on all six pages


def test_copies_of_a_page_keep_their_article(spark):
    rows = [(i, "http://c.example/x", site(1, "<p>same text</p>"), "") for i in range(40)]
    assert {r.text for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"same text"}


def test_nulls_cut_pages_and_empty_table(spark):
    rows = [(1, None, None, ""), (None, None, "<p>a</p", ""), (2, "http://x.example/", "", ""), (3, "x", "plain\n text", ""), (4, "", "<article><p>a<b", "")]
    got = h.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.page_id, r.text) for r in got} == {(1, ""), (None, "a"), (2, ""), (3, "plain text"), (4, "a")}
    assert h.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_unmarked_boilerplate_inside_an_article_goes(spark):
    page = "<html><body><article><h1>Story {0}</h1>{1}<p>Subscribe to our list today</p></article></body></html>"
    body = ["".join(f"<p>part {k} of {i}</p>" for k in range(1 + i % 3)) for i in range(12)]
    rows = [(i, f"http://h.example/{i}", page.format(i, body[i]), "") for i in range(12)]
    # copies and versions of one article keep what they share
    rows += [(100 + i, "http://v.example/", page.format(7, f"<p>as before</p><p>version {i}</p>"), "") for i in range(4)]
    # a passage that some articles share is no template
    shared = "<p>A passage</p>"
    rows += [(200 + i, "http://s.example/", f"<html><article><p>one {i}</p>{shared if i < 4 else ''}</article>", "") for i in range(6)]
    got = {r.page_id: r.text.split("\n") for r in h.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(got[i] == [f"Story {i}", *(f"part {k} of {i}" for k in range(1 + i % 3))] for i in range(12))
    assert all(got[100 + i] == ["Story 7", "as before", f"version {i}", "Subscribe to our list today"] for i in range(4))
    assert all(got[200 + i] == [f"one {i}"] + ["A passage"] * (i < 4) for i in range(6))


def test_roles_are_whole_class_names():
    kept, gone = ["ad-hoc", "search-party-story", "x"], ["ad", "user-comments", "ad-slot", "related-posts", "x cookie_banner"]
    page = "<article>" + "".join(f"<p class='{c}'>{c}</p>" for c in kept + gone) + "</article>"
    assert h.main_text(page, set(), False).split("\n") == kept


def test_vectors_classes_and_nesting_by_brute_force(spark):
    """Classes are the valid tokens with equal occurrence vectors below one element."""
    page = "<html><body><div class=a><ul>{}</ul></div><div class=b><p>x{}</p><hr><p>y</p></div>{}</body></html>"
    htmls = [page.format("<li>k<li>k", i, "<section><i>z</i></section>" * (i % 5 != 0) + "<em>q</em>" * i) for i in range(10)]
    found = h.templates(spark.createDataFrame([(i, "http://h.example/", x, "") for i, x in enumerate(htmls)], SCHEMA).repartition(4)).collect()[0]
    vectors, around = {0: [1] * 10}, {0: 0}
    for i, x in enumerate(htmls):
        for kind, path, text, _, _, _, up in h.nodes(x):
            token = h._hash(kind, path) if kind != "text" else h._hash(kind, path, h.clean(text))
            vectors.setdefault(token, [0] * 10)[i] += 1
            around[token] = h._hash("open", up) if up else 0
    valid = {t: tuple(v) for t, v in vectors.items() if sum(map(bool, v)) >= 5 and len(set(v) - {0}) == 1}

    def slot(t):
        up = around[t]
        while up and valid.get(up, valid[t]) == valid[t]:
            up = around[up]
        return up

    want = {}
    for t in set(valid) - {0}:
        want.setdefault((valid[t], 0 if valid[t] == valid[0] else slot(t)), set()).add(t)
    assert found.n_pages == 10 and len(want) >= 4
    assert {frozenset(c.tokens) for c in found.classes} == {frozenset(g) for g in want.values()}
    assert {frozenset(c.tokens): c.slot for c in found.classes} == {frozenset(g): at for (_, at), g in want.items()}
    opened = {h._hash(k, p) for x in htmls for k, p, *_ in h.nodes(x) if k == "open"}
    assert {s.element for s in found.slots} == opened & set(valid)
