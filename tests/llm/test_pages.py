import numpy as np

from tideq.llm import pages


def test_structure():
    html = (
        '<body><header class="site-header"><a>Home</a></header><div class="cookie-notice">We use<p>cookies</p></div><article><header><h1>T &amp; x</h1></header>'
        '<p>One<b> two</b>\n three<p>Four &lt;i&gt; &#233; &am<div class="comments"><p>nice</p></div><aside>side</aside><p>End</article><footer>f</footer>'
    )
    assert pages.blocks_of(html) == (["T & x", "One two three", "Four <i> é &am", "End"], True)
    assert pages.blocks_of(None) == ([], False) and pages.blocks_of("plain <b>text") == (["plain text"], False)
    assert pages.blocks_of("<div class=ad>x<article><p>y</article>z") == (["y"], True)
    assert pages.blocks_of('<script>var t="</p>";</script><style>p{}</style><form><p>q</form><p>a<br>b') == (["a b"], False)


def brute(streams, page, run, least):
    where = {}
    for s, p in zip(streams, page):
        for i in range(len(s) - run + 1):
            where.setdefault(tuple(s[i : i + run]), set()).add(p)
    out = []
    for s in streams:
        flag = [False] * len(s)
        for i in range(len(s) - run + 1):
            if len(where[tuple(s[i : i + run])]) >= least:
                flag[i : i + run] = [True] * run
        out.append(flag)
    return out


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(5)
    for run, least in ((1, 2), (3, 2), (4, 3), (5, 2)):
        streams = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(12)]
        page = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9])
        assert [list(x) for x in pages.covered(streams, page, run, least)] == brute(streams, page, run, least)


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark):
    common = "this very same line of nine words stands everywhere"
    rows = [(i, f"http://h.example/{i}", f"<p>{common}<p>unique text number {i} here {common}") for i in range(5)] + [(9, None, None), (9, None, None), (10, "odd", "<p>x")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:5] == [(i, f"unique text number {i}", 20) for i in range(5)]
    assert got[5:] == [(9, "", 0), (9, "", 0), (10, "x", 1)]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_count_over_all_shards_of_a_host(spark):
    """Pages without marks against brute force: the result is that of whole hosts, at any size of a shard."""
    rng = np.random.default_rng(9)
    rare = "a passage of ten words that stands on three pages"
    bodies = [[" ".join(f"w{x}" for x in rng.integers(0, 10**6, 20)), "menu of the host with many words in it here"] for _ in range(600)]
    for i in (7, 200, 555):
        bodies[i].insert(1, f"before{i} {rare} after{i}")
    for i in (8, 300):
        bodies[i].append("only two pages have these words so they stay here")
    rows = [(i, f"http://big.example/{i}", "".join(f"<p>{x}" for x in body)) for i, body in enumerate(bodies)]
    rows += [rows[7], rows[7]]
    rows += [(1000 + i, f"http://two.example/{i}", f"<p>{rare}" if i < 2 else "<article>" + rare + "</article>") for i in range(3)]
    rows += [(2000 + i, f"http://marked.example/{i}", f"<main>{rare}</main>") for i in range(4)]
    streams = [x.split(" ") for body in bodies for x in body]
    flags = iter(brute(streams, [i for i, body in enumerate(bodies) for _ in body], 8, 3))
    want = []
    for body in bodies:
        kept = [" ".join(t for t, gone in zip(x.split(" "), next(flags)) if not gone) for x in body]
        want.append("\n".join(x for x in kept if x))
    assert "before7 after7" in want[7] and "only two" in want[8] and "menu" not in "".join(want)
    data = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for shard in (2_000, pages.SHARD):
        got = [(r.page_id, r.text) for r in pages.extract(data, shard=shard).collect()]
        assert len(got) == len(rows) and got.count((7, want[7])) == 3
        found = dict(got)
        assert [found[i] for i in range(600)] == want
        assert [found[1000 + i] for i in range(3)] == ["", "", rare] and all(found[2000 + i] == rare for i in range(4))


def test_names_of_articles_headings_and_slugs_leave_nothing_out():
    kept = [
        '<article id="post-the-search-for-truth"><p>x</article>', '<article class="social-history login"><p>x</article>', '<main id="menu"><h2 id="login">x</h2></main>',
        '<main><div class="form-of-address" id="how-to-share-a-notice">x</div></main>',
    ]
    assert [pages.blocks_of(html) for html in kept] == [(["x"], True)] * 4
    gone = ("reader-replies", "comment-list", "comments-area", "responses", "cookie-notice-2", "site-header social_links", "AdBox ad", "nav_main")
    assert [pages.blocks_of(f'<body><div class="{name}">no</div><p>x') for name in gone] == [(["x"], False)] * len(gone)
    assert pages.blocks_of('<p>a < b<p>c<a href="never ends') == (["a < b", "c"], False)


def test_a_megabyte_of_odd_tags_takes_time_in_proportion():
    import time

    def spent(n):
        began = time.process_time()
        for html in ("<div>" * n + "</b>" * n, "<a " * n, "<div><article>" + "<b>" * n + "</div>" * n, "<div>" * n + "<nav><article></article>" * n):
            pages.blocks_of(html)
        return time.process_time() - began

    spent(1_000)
    assert spent(40_000) < 12 * spent(10_000)


def test_a_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(150_000))
    row = pages.extract(spark.createDataFrame([(1, "u", f"<nav>no</nav><p>{words}</p>")], "page_id long, url string, html string")).first()
    assert row.text == words and row.n_chars == len(words)


def test_odd_sections_and_long_references_raise_nothing():
    """Marked sections of no known kind and references of thousands of digits, on which the library's parser raises errors."""
    for section in ("<![foo[y]]>", "<![>", "<![1]>", "<![ =y>"):
        assert pages.blocks_of(f"<article><p>a {section}b</p></article>") == (["a b"], True), section
    nines, zeros = "&#" + "9" * 5000 + ";", "&#" + "0" * 5000 + "65;"
    assert pages.blocks_of(f'<article><a title="{nines}">x {nines} {zeros}</a></article>') == (["x � A"], True)


def test_arrays_go_over_marked_pages_too(spark):
    """On a host whose pages all mark their article the arrays didn't run: nothing told what its pages repeat."""
    passage = "ten words of a passage that stands on several pages"
    rows = [(i, f"http://m.example/{i}", f"<nav>menu</nav><article><p>own {i}<p>{passage}</article>") for i in range(7)] + [(None, "http://m.example/6", f"<nav>menu</nav><article><p>own 6<p>{passage}</article>")]
    rows += [(10 + i, f"http://n.example/{min(i, 1)}", f"<main>{passage}</main>") for i in range(5)]
    for shard in (100, pages.SHARD):
        got = sorted(((r.page_id, r.text, r.n_repeated) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=shard).collect()), key=str)
        # pages of one url and html count as one: only two pages of the second host have the passage
        want = [(i, f"own {i}\n{passage}", 10) for i in range(7)] + [(None, f"own 6\n{passage}", 10)] + [(10 + i, passage, 0) for i in range(5)]
        assert got == sorted(want, key=str)


def test_lists_of_buckets():
    for numbers in ([], [0], [0, 0, 5, 70_000, 2**32 - 1]):
        assert list(pages.unpacked_list(pages.packed_list(np.array(numbers, dtype=np.int64)))) == numbers
