"""Archives by round trip; main text of pages whose article is known."""

import base64
import hashlib

from terrafold.llm import warc, wrappers


def test_archives_hold_what_was_written(spark):
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\nWARC/1.1" * 9000), (None, "http://f", "only"), (None, None, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    best, want = {}, []
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    seen = set()
    for i, _, h in rows:
        raw, win = (h or "").encode(), best[h or ""]
        first = (win == (-1 if i is None else i)) and (h or "") not in seen
        if first:
            seen.add(h or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else win))
    assert sorted(map(tuple, warc.archived(df).collect()), key=str) == sorted(want, key=str)
    assert warc.archived(df.where("false")).collect() == []


def test_dictionary_frame():
    records = [warc.record("response", [("X-Page-Id", str(i))], f"<html><body><p>page {i} of a site with a common frame</p></body></html>".encode()) for i in range(500)]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.frames(data))[1:] == records


def page(k, body):
    return f"""<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/{k}">menu {k}</a></li></ul></nav>
    <div class="ad">advert {k}</div><article><h1>Title&nbsp;{k} &amp; more</h1>{body}<p>Subscribe to our paper</p></article><div id="comments"><p>reader {k}</p></div><aside>side</aside><footer>&copy; {k}</footer>"""


def test_main_text(spark):
    rows = [(k, f"http://H.example/{k}", page(k, f"<p><b>first {k}<br>line\n  {k}<p>second {k} <!-- no --> text that is long enough to be most of what the article says, as number {k}</p>")) for k in range(12)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://g/", "<p>no article <i>here</i></p><ul><li><a href=x>link</a></li></ul>"), (None, "http://g/", "plain <b>text</b> < 3 &lt;")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(df).collect()}
    for k in range(12):  # the constant last paragraph is template
        text = f"Title {k} & more\n\nfirst {k} line {k}\n\nsecond {k} text that is long enough to be most of what the article says, as number {k}"
        assert got[k] == (text, len(text))
    assert got[100] == got[101] == ("", 0) and got[102][0] == "no article here" and got[None][0] == "plain text < 3 <"
    assert wrappers.extract(df.where("false")).collect() == []


def test_copies_are_no_template(spark):
    body = "<p>the very same article on every page</p><p>with two paragraphs</p>"
    rows = [(k, "http://h/", page(0, body).replace("menu 0", f"menu {k}")) for k in range(9)]
    got = {r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1 and "the very same article on every page" in got.pop()


def plain(k, words, ad=120):
    """A page without article tags or telling names: only what its layout's other pages show tells the text from the rest."""
    text = f"<h1>Head {k}</h1>" + "".join(f"<p>part {j} of {k} {'x' * words}</p>" for j in range(4))
    return f"<html><body><div class=q1><div><p>deal {k} {'y' * ad}</p></div></div><div class=q2>{text}</div><div class=q3><div><p>imprint of the site</p><p>line {k}</p></div></div></body></html>"


def test_the_wrapper_decides(spark):
    """On a short page the longest block is an advert; the region comes from the other pages of its layout."""
    pages = [plain(k, 900) for k in range(20)] + [plain(99, 3)]
    rows = [(k, "http://h/", p) for k, p in enumerate(pages)]
    df = spark.createDataFrame([*rows, rows[-1]], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    for k, p in enumerate(pages):
        name = 99 if k == 20 else k
        assert got[k] == "\n\n".join([f"Head {name}", *[f"part {j} of {name} {'x' * (3 if k == 20 else 900)}" for j in range(4)]])
        assert wrappers.main_text(p, None) != got[k]


def matched_size(a, b):
    """The size of the largest simple tree matching, by its definition."""
    from functools import cache

    kids = [{k: [i for i, n in enumerate(side) if n[1] == k] for k in range(-1, len(side))} for side in (a, b)]

    @cache
    def forest(i, j):
        left, right = kids[0][i], kids[1][j]
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for x, p in enumerate(left, 1):
            for y, q in enumerate(right, 1):
                both = best[x - 1][y - 1] + 1 + forest(p, q) if a[p][0] == b[q][0] else 0
                best[x][y] = max(best[x - 1][y], best[x][y - 1], both)
        return best[-1][-1]

    return forest(-1, -1)


def test_matching_is_the_largest():
    import random

    rng = random.Random(5)
    for _ in range(300):
        trees = []
        for _ in range(2):
            nodes, path = [], [-1]
            for k in range(rng.randrange(13)):
                path = path[: rng.randrange(1, len(path) + 1)]
                nodes.append([rng.choice("abc"), path[-1]])
                path.append(k)
            trees.append(nodes)
        a, b = trees
        pairs = wrappers.matched(a, b)
        of = dict(pairs)
        assert len(pairs) == len(of) == len(set(of.values())) == matched_size(a, b)
        assert all(a[i][0] == b[j][0] and of.get(a[i][1], -1) == b[j][1] for i, j in pairs)


def test_long_and_deep_pages():
    """10,000 blocks are aligned, and 20,000 levels read, in seconds; what a menu holds goes at any depth."""
    import time

    start = time.time()
    long = ["".join(f"<div class=c{(k * s) % 7}><p>text {k} {s}</p></div>" for k in range(10_000)) for s in (3, 5)]
    nodes = [wrappers.skeleton(wrappers.tree(p))[0] for p in long]
    assert len(wrappers.matched(*nodes)) > 5_000
    deep = "<div>" * 20_000 + "<nav>menu</nav><aside>side</aside>text" + "</div>" * 20_000
    assert wrappers.main_text(deep) == "text"
    assert time.time() - start < 60


def test_names_dont_empty_an_article():
    html = "<article><div class='related-work'><p>one</p></div><div class='header'><p>two</p></div><div class='search-algorithms'><p>three</p></div><div class=ad><p>buy</p></div></article>"
    assert wrappers.main_text(html) == "one\n\ntwo\n\nthree"
    assert wrappers.main_text("<article><section class='notice'><p>all of it</p></section></article>") == "all of it"
    assert wrappers.main_text("<p>see <a href=x>this whole sentence that links</a></p>") == "see this whole sentence that links"


def test_dictionary_sees_the_whole_archive(monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 64 << 10)
    seen = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, samples, **_: seen.extend(samples) or warc.zstandard.ZstdCompressionDict(b"x" * 500))
    warc.dictionary([bytes([k % 251]) * 20_000 for k in range(500)])
    assert {s[0] for s in seen} >= {0, 250} or len({s[0] for s in seen}) > 5


def test_ids_within_an_article():
    """Ids and headings' names take nothing from an article; the same ids outside of one do, and so do classes."""
    kept = ['<h2 id="promotion">Promotion</h2>', '<h2 class="search">Search</h2>', '<section id="advertising"><h3 id="ad">On adverts</h3><p>What adverts do.</p></section>', '<p id="comments">Comments on a text.</p>', '<div id="menu"><p>The menu was long.</p></div>']
    gone = ['<div class="ad">buy</div>', '<section class="comments"><p>a reader</p></section>', '<form id="x"><label>name</label><input></form>']
    for tag in ("article", "main"):
        text = wrappers.main_text(f'<body><div id="comments"><p>outside</p></div><{tag}>{"".join(kept)}<p>{"A plain sentence of the text. " * 9}</p>{"".join(gone)}</{tag}></body>')
        assert text.split("\n\n")[:6] == ["Promotion", "Search", "On adverts", "What adverts do.", "Comments on a text.", "The menu was long."]
        assert not any(w in text for w in ("buy", "reader", "name", "outside"))


def test_math_and_labels_stay_inline():
    text = wrappers.main_text("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here.</p><p>A <label>named</label> place.</p><object data=x><p>What is told without it.</p></object><p style='display:none'>Folded away.</p></article>")
    assert text == "Energy is E=mc2 here.\n\nA named place.\n\nWhat is told without it.\n\nFolded away."


def test_pages_without_article_tags(spark):
    """The given pages, articles in plain elements and adverts unnamed: wrappers find what the tags told."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = pages.selectExpr("page_id", "url", "replace(regexp_replace(html, '<(/?)article', '<$1div'), 'class=\"ad\"', '') AS html")
    want = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    got = {r.page_id: r.text for r in wrappers.extract(bare).collect()}
    assert len(want) == len(got) and sum(got[k] == t for k, t in want.items()) >= 0.9 * len(want)
