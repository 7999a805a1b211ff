import random
import time
from collections import defaultdict

import numpy as np

from vexel.llm import html_extraction
from vexel.llm.html_blocks import BOILERPLATE, CONTENT, NEUTRAL, blocks_of
from vexel.llm.html_extraction import extract_text, main_texts, op3_host_suffix_array, repeated_positions, suffix_order

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home-page">
<nav><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>Big &amp; bold</h1></header><p><b>First&nbsp; part</b>ial<br>line &lt;3 &#233;<p>Second</p><!-- <p>no</p> --><form><p>Sign up</p></form>
<table><tr><td>x</td><td>y</td></tr></table><div class="share-buttons">Tweet</div></article>
<section class="comments"><p>Nice!</p></section><aside>More</aside><footer>&copy; me</footer>"""


def test_blocks_and_roles():
    got = [(b.text, b.role) for b in blocks_of(PAGE)]
    assert [t for t, r in got if r == CONTENT] == ["Big & bold", "First partial line <3 é", "Second", "x", "y"]
    assert {t for t, r in got if r == BOILERPLATE} == {"Home", "About", "Buy", "We use cookies", "Sign up", "Tweet", "Nice!", "More", "© me"}
    assert main_texts([blocks_of(PAGE)]) == ["Big & bold\nFirst partial line <3 é\nSecond\nx\ny"]


def test_broken_markup():
    for page in ("", "<", "<p", "<p>a", "a<b", "</p></div>x", "<script>never closed", "<!-- open", "<p title='>'>q</p>", "&", "&am", "<" * 2000, "<a '" * 500, "<div>" * 3000 + "deep"):
        assert all(b.text for b in blocks_of(page))
    assert [b.text for b in blocks_of("<p title='>'>q</p>r &amp")] == ["q", "r &"]


def test_suffixes_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        pages = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 5))]
        tokens = [t for p, row in enumerate(pages) for t in [*row, -1 - p]]
        page_of = [p for p, row in enumerate(pages) for _ in [*row, 0]]
        where = defaultdict(set)
        for i in range(len(tokens) - 3):
            if min(tokens[i : i + 4]) >= 0:
                where[tuple(tokens[i : i + 4])].add(page_of[i])
        want = [False] * len(tokens)
        for i in range(len(tokens) - 3):
            if len(where[tuple(tokens[i : i + 4])]) > 1:
                want[i : i + 4] = [True] * 4
        assert repeated_positions(np.array(tokens), np.array(page_of), 4).tolist() == want
        order, rank = suffix_order(np.array(tokens), 4)
        assert [tokens[i : i + 4] for i in order] == sorted(tokens[i : i + 4] for i in range(len(tokens))) and len(rank) == len(tokens)


def test_repeats_decide_where_markup_is_silent():
    menu = "<div>Home About Contact Imprint Terms Privacy Jobs Press Help</div>"
    rng = random.Random(2)
    bodies = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)]
    pages = [blocks_of(f"{menu}<div>{b}</div>") for b in bodies]
    assert {b.role for p in pages for b in p} == {NEUTRAL} and main_texts(pages) == bodies
    assert main_texts(pages[:1]) == [menu[5:-6] + "\n" + bodies[0]]
    same = [blocks_of(f"<nav>{menu}</nav><article><p>{bodies[0]}</p></article>")] * 3
    assert main_texts(same) == [bodies[0]] * 3  # copies of an article stay


def test_table(spark, small_dir):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    found = op3_host_suffix_array(spark, small_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        own = rows[r["page_id"]]
        article = own[own.index("<article>") + 9 :].split("</article>")[0]
        want = [b.text for b in blocks_of(article)]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "http://h/x", "", 2), (2, "http://H:80/", PAGE, 3), (2, "http://H:80/", PAGE, 3), (3, "not a url", "plain text", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    found = extract_text(pages).collect()
    assert len(found) == 5 and sorted(r["n_chars"] for r in found)[:2] == [0, 0] and {r["text"] for r in found if r["page_id"] == 3} == {"plain text"}
    assert extract_text(pages.limit(0)).count() == 0


def soup_pages(n, seed=5):
    """Pages of one host without landmarks: a shared menu, a notice that a tenth of them have, and their own text."""
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    menu, notices, out = words(12), [words(15) for _ in range(n // 10)], []
    for i in range(n):
        notice = notices[i % len(notices)]
        body = [words(rng.randint(10, 40)) for _ in range(3)]
        out.append((i, "http://soup/%d" % i, f"<div>{menu}</div>" + "".join(f"<div>{b}</div>" for b in (body[0], notice, *body[1:])), "\n".join(body)))
    return out


def test_the_array_decides_unmarked_pages(spark, monkeypatch):
    """Without the array every text is another; a host cut to parts gives what a whole one gives."""
    rows = soup_pages(200)
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = {r[0]: r[3] for r in rows}
    assert {r["page_id"]: r["text"] for r in extract_text(pages).collect()} == want
    monkeypatch.setattr(html_extraction, "PART_BYTES", 6000)
    assert {r["page_id"]: r["text"] for r in extract_text(pages).collect()} == want
    monkeypatch.setattr(html_extraction, "repeated_positions", lambda tokens, page_of, run=8: np.zeros(len(tokens), bool))
    off = main_texts([blocks_of(r[2]) for r in rows])
    assert sum(a != b for a, b in zip(off, want.values(), strict=True)) == 200


def test_cut_hosts_know_repeats_in_marked_blocks(spark, monkeypatch):
    """Words that one page leaves open and others have in a menu or an article: covered in a whole host, and so in one cut to parts."""
    rng = random.Random(6)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    menu, story, rows = words(14), words(30), []
    for i in range(40):
        shared = f"<nav>{menu}</nav><article><p>{story}</p></article>" if i % 4 else f"<div>{menu}</div><div>{story}</div>"
        rows.append((i, f"http://mixed{i // 4}/{i}", f"{shared}<div>{words(20)}</div>" if i % 2 else shared))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    assert [whole[i] for i in range(0, 40, 4)] == [""] * 10
    monkeypatch.setattr(html_extraction, "PART_BYTES", 50)
    assert {r["page_id"]: r["text"] for r in extract_text(pages).collect()} == whole


def test_unmarked_blocks_beside_an_article():
    pages = [blocks_of(f"<div>{' '.join(f's{k}' for k in range(12))}</div><article><p>own {i}</p></article><div>{' '.join(f'u{i}x{k}' for k in range(12))}</div>") for i in range(3)]
    assert main_texts(pages) == [f"own {i}\n" + " ".join(f"u{i}x{k}" for k in range(12)) for i in range(3)]


def test_hostile_pages_take_linear_time():
    for page in ("<div>" * 100_000 + "</section>" * 100_000, "<a title='y " * 50_000, '<p class="x' * 50_000, "<b>" * 50_000 + "x</div>" * 50_000, "<ul><li>x" * 50_000):
        began = time.perf_counter()
        blocks_of(page)
        assert time.perf_counter() - began < 3
