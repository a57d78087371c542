"""Wrappers and main texts against pages whose text is known."""

import html
import itertools
import random

import pytest


from lexloom.llm import extract as x


def text_of(*pages, of=None):
    """The main texts of pages of one host."""
    total = None
    for p in pages:
        one = x.condense(x.parse(p))[0]
        total = x.merge(total, one) if total else one
    found = {k: frozenset(v) for k, v in x.regions(total).items()}
    return [x.main_text(p, found["roots"], found["drops"], found["folded"]) for p in (of or pages)]


ARTICLE = "<html><head><title>t</title><style>p{{}}</style><script>var t='</p><article>no</article>';</script></head><body><header class=site><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>{}<aside>side</aside><section id='comments'><article class='comment'>first!</article></section><form>name <input></form><footer>&copy; x</footer></body></html>"


def test_semantic_page():
    page = ARTICLE.format("<article class='long-form'><header><h1>Head &amp; line</h1><p class=byline>By me</p></header><p>One\n <b>two</b>&nbsp;three<br>four</p><div class='ad-box'>Buy</div><ul><li>a<li>b</ul><!-- <p>gone</p> --><p>five &am six &amp</article>")
    assert text_of(page) == ["Head & line\nBy me\nOne two three four\na\nb\nfive &am six &"]


def test_unclosed_tags_and_truncation():
    page = "<article><h1>T</h1><p><b>one<br><p>two</p></i>three</p>four<table><tr><td>a<td>b<tr><td>c</table><div>x<p>y</div>z"
    assert text_of(page) == ["T\none\ntwo\nthree\nfour\na\nb\nc\nx\ny\nz"]
    assert text_of("<p class='a>b' title=\"</p>\">in</p><p") == ["in\n<p"]
    assert text_of("just text &lt;b&gt;", "") == ["just text <b>", ""]


def test_a_form_around_the_page():
    assert text_of("<form id=aspnet><nav>n</nav><main><h2>a</h2>b</main></form>") == ["a\nb"]


def unmarked(k, extra=""):
    menu = "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(6))
    return f"<body><div class=q1><b>The Daily Site</b></div><ul class=q2>{menu}</ul><div class=q3><h1>Title {k}</h1><div class=q4><p>Body text number {k} is long enough to be the text of this page, with words {'and more ' * (k + 5)}</p>{extra}</div></div><div class=q9>All rights reserved, (c) us</div></body>"


def test_template_parts_without_marks():
    """Constant texts and link lists are known by the wrapper alone."""
    pages = [unmarked(k, "<p>A closing paragraph.</p>" if k % 2 else "") for k in range(6)]
    for k, got in enumerate(text_of(*pages)):
        assert got.split("\n")[0] == f"Title {k}" and got.count("\n") == 1 + k % 2 and "menu" not in got and "rights" not in got and "Daily" not in got
    assert "rights" in text_of(unmarked(1))[0]  # one page alone does not say what is template


def test_equal_pages_keep_their_text():
    assert len(set(text_of(*[unmarked(3)] * 5))) == 1 and "Body text" in text_of(*[unmarked(3)] * 5)[0]


def test_alignment_finds_optional_and_repeated_parts():
    pages = ["<h1>a</h1><p>x</p><p>y</p><i>z</i>", "<h1>b</h1><div class=n>c</div><p>x</p>", "<h1>b</h1><h2>s</h2><p>1</p><h2>t</h2><p>2</p>"]
    total = None
    for p in pages:
        one = x.condense(x.parse(p))[0]
        total = x.merge(total, one) if total else one
    assert x.expression(total) == "<body>(<h1>(#PCDATA) <div.n>(#TEXT)? (<p>(#PCDATA)* <h2>(#PCDATA)*)+)"


def test_order_of_pages_does_not_matter():
    rng = random.Random(1)
    pages = ["".join(rng.choice(["<h1>{}</h1>", "<p>{}</p>", "<div class=k{}>w</div>", "<ul><li>{}</li></ul>", "<section><p>{}</p><h2>q</h2></section>"]).format(rng.randrange(4)) for _ in range(rng.randrange(1, 9))) for _ in range(5)]
    found = set()
    for order in itertools.permutations(pages):
        parts = [x.condense(x.parse(p))[0] for p in order]
        found.add(str(x.regions(x.merge(x.merge(parts[0], parts[1]), x.merge(x.merge(parts[2], parts[3]), parts[4])))))
    assert len(found) == 1


def test_many_classes_become_one_label():
    pages = ["<article>" + "".join(f"<div class='c{chr(97 + a)}{chr(97 + b)}'>t{a}{b}</div>" for a in range(10) for b in range(10)) + "<div class=sharing>s</div></article>"] * 2
    one = x.condense(x.parse(pages[0]))[0]
    assert x.expression(one).count("<div") == 1
    assert text_of(*pages)[0] == "\n".join(f"t{a}{b}" for a in range(10) for b in range(10))


def test_deep_and_long_pages():
    deep = "<article>" + "<div>" * 5000 + "<p>in</p>" + "</div>" * 5000 + "<p>after</p></article><div class=ad>ad</div>"
    assert text_of(deep) == ["in\nafter"]
    words = " ".join(f"w{i}" for i in range(200_000))
    assert text_of(f"<article><p>{words}</p></article>") == [words]
    assert text_of("<article>" + "<p a='" * 3000)[0].startswith("<p a=")


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for k in range(60):
        body = " ".join(f"word{(k * 7 + j) % 50}" for j in range(30))
        rows.append((k, f"http://hot.example/{k}", ARTICLE.format(f"<article><h1>H {k}</h1><p>{html.escape(body)}</p></article>")))
    rows += [(100 + k, f"https://User@Other.Example:80/{k}", unmarked(k)) for k in range(4)]
    rows += [(200, None, "<p>a</p>"), (201, "http://hot.example/x", None), (202, "", ""), (0, "http://hot.example/0", rows[0][2]), (None, "odd", "<p>no host</p>")]
    return spark.createDataFrame([(*r, "h", "r", "t") for r in rows], "page_id long, url string, html string, host string, regions string, text string").repartition(7)


def test_table(spark, table, monkeypatch):
    monkeypatch.setattr(x, "FAN", 2)  # several rounds of merging
    got = x.main_texts(table)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string")]
    rows = {(r.page_id, r.url): r.text for r in got.collect()}
    assert len(got.collect()) == table.count() and len(rows) == table.count() - 1
    for k in range(60):
        assert rows[k, f"http://hot.example/{k}"] == f"H {k}\n" + " ".join(f"word{(k * 7 + j) % 50}" for j in range(30))
    assert rows[100, "https://User@Other.Example:80/0"].startswith("Title 0\nBody") and "rights" not in rows[100, "https://User@Other.Example:80/0"]
    assert (rows[200, None], rows[201, "http://hot.example/x"], rows[202, ""], rows[None, "odd"]) == ("a", "", "", "no host")
    monkeypatch.setattr(x.cluster, "BROADCAST_BYTES", 0)
    assert sorted(x.main_texts(table).collect(), key=str) == sorted(got.collect(), key=str)
    assert {r.host for r in x.wrappers(table.select(x.host_of("url").alias("host"), "html")).collect()} == {"hot.example", "other.example", ""}
    assert x.main_texts(table.limit(0)).collect() == []
