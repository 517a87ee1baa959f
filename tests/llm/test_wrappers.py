"""Main text extraction: made-up pages with known articles, broken markup, and wrapper shapes."""

import random

from tracehound.llm import wrappers


def page(rng, host, blocks):
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta caf&eacute; x&lt;y &amp; one two three".split()) for _ in range(n))
    if host == "a.example":
        inner = "".join(f"<p><b>{b}<br>" if k % 4 == 2 else f"<p>{b}</p>" for k, b in enumerate(blocks[1:]))
        ad = f'<div class="ad">{words(30)}</div>' if rng.random() < 0.5 else ""
        end = rng.choice(["", "</body></html>"])
        return f'<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{"".join("<li><a href=/>x</a></li>" for _ in range(rng.randint(1, 5)))}</ul></nav>{ad}<article><h1>{blocks[0]}</h1>{inner}</article><section id="comments"><p>{words(60)}</p></section><footer>&copy; {words(5)}</footer>{end}'
    inner = "".join(f"<div>{b}\n</div>" for b in blocks[1:])
    return f'<html><body class=has-sidebar><header><h2>site</h2></header><form>{words(9)}<input name=q></form><div id=wrap><div class="cookie-notice">{words(50)}</div><div id="content-{rng.randint(1, 99)}"><h1>{blocks[0]}</h1>{inner}<aside>{words(40)}</aside></div></div><div class="sidebar"><p>{words(80)}</p></div></body></html>'


def test_articles(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        host = ["a.example", "b.example"][i % 2]
        clean = [" ".join(rng.choice(["red", "green", "blau", "é"]) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(2, 9))]
        clean[1] += " a < b & c"
        raw = [b.replace("&", "&amp;").replace("< ", "&lt;\n  ").replace("é", rng.choice(["&eacute;", "&#233;", "é"])) for b in clean]
        rows.append((i, f"https://{host}/p/{i}", page(rng, host, raw), "extra"))
        want[i] = "\n\n".join(clean)
    rows += [(100, None, None, "x"), (101, "https://a.example/z", "", "x"), (102, "nonsense", "just <b>text</b> & more", "x"), (103, "https://c.example/", "<p>cut off <a href=", "x"), (104, "https://c.example/", "</div></p><!-- open", "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = {r.page_id: r for r in wrappers.extract(docs).collect()}
    assert {i: got[i].text for i in want} == want
    assert [got[k].text for k in (100, 101, 102, 103, 104)] == ["", "", "just text & more", "cut off", ""]
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)


def test_inferred_expression():
    trees = [wrappers.parse(h)[0] for h in ("<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><p>z</p></div>", "<div><h1>b</h1><p>x</p><ul><li>1<li>2</ul></div>")]
    out = trees[0]
    for t in trees[1:]:
        out = wrappers.merge(out, t)
    assert wrappers.expression(out) == "<div>(<h1>#</>)? (<p>#</>)+ (<ul>(<li>#</>)+</>)?</>"
    again = wrappers.Node.load(out.dump())
    assert wrappers.expression(again) == wrappers.expression(out)


def test_groups_fold():
    tree = wrappers.parse("<dl>" + "<dt>k<dd>v" * 5 + "</dl>")[0]
    assert wrappers.expression(tree) == "<dl>(<dt>#</>)+ (<dd>#</>)+</>"


def test_empty(spark):
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_constant_menu_is_template(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta one two three four".split()) for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        text = [words(30), words(25), words(40)]
        inner = "".join(f"<p>{t}</p>" for t in text)
        rows.append((i, "https://t.example/x", f'<body><div class="x1">Home About us Prices</div><div class="x2">{inner}<div class="x7">Read this first</div></div><div class="bar">Made by us</div></body>'))
        want[i] = "\n\n".join(text)
    rows += [(30 + k, "https://few.example/", '<body><div class="x1">Home About</div><p>The very same text here</p></body>') for k in range(3)]
    rows += [(40 + k, "https://mirror.example/", "<body><p>The very same text here</p></body>") for k in range(20)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[30 + k] == "Home About\n\nThe very same text here" for k in range(3)) and all(got[40 + k] == "The very same text here" for k in range(20))


def test_without_noise_words(spark, monkeypatch):
    """Template text goes without any list of names; the workers get the module's list, so a tree is matched here."""
    monkeypatch.setattr(wrappers, "NOISE_WORDS", frozenset())
    pages = [f'<body><div class="cookie-notice">We use cookies</div><div class="c">{"".join(f"<p>story {i} part {k}</p>" for k in range(6))}</div><div class="sidebar">Best of</div></body>' for i in range(12)]
    tree = wrappers.parse(pages[0])[0]
    for p in pages[1:]:
        tree = wrappers.merge(tree, wrappers.parse(p)[0])
    tree = wrappers.Node.load(tree.dump())
    fixed = {tuple(x) for x in wrappers.template(tree)}
    assert [wrappers.article(p, wrappers.main_path(tree), fixed) for p in pages] == ["\n\n".join(f"story {i} part {k}" for k in range(6)) for i in range(12)]


def test_two_templates_on_a_host(spark):
    rows = [(i, "https://t.example/", f"<body><article><p>{'long story of page ' + str(i)} {'and more ' * 40}</p></article></body>") for i in range(12)]
    rows.append((50, "https://t.example/", f"<body><article><p>teaser</p></article><div class=content><p>{'the real text ' * 30}</p></div></body>"))
    rows.append((51, "https://t.example/", f"<body><article hidden><p>not shown</p></article><article><p>{'shown text ' * 30}</p></article></body>"))
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[50] == ("the real text " * 30).strip() and got[51] == ("shown text " * 30).strip() and got[3].startswith("long story of page 3")


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 100_000 + "core text" + "</div>" * 50_000
    rng = random.Random(2)
    wide = ["".join(f'<div class="{"".join(rng.choice("abcdefgh") for _ in range(3))}">{k}</div>' for k in range(6000)) for _ in range(3)]
    rows = [(0, "https://d.example/", deep), (1, "https://d.example/", deep)] + [(2 + k, "https://w.example/", w) for k, w in enumerate(wide)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[1] == "core text" and got[3].split("\n\n") == [str(k) for k in range(6000)]


def test_alignment_by_increasing_run(monkeypatch):
    x, y = list("abcabdxbc"), list("abdabcybc")
    for limit in (20_000, 0):
        monkeypatch.setattr(wrappers, "ALIGN", limit)
        got = wrappers._aligned(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:])) and len(got) >= 6
