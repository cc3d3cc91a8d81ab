"""Wrapper induction: what the wrapper decides, where marks mislead, odd pages and the size of wrappers."""

from __future__ import annotations

import random

from sylvameter.llm import extraction
from sylvameter.llm.extraction import Page, Wrapper, main_text, merge

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore".split()


def _induce(sources, weights=None):
    whole = None
    for source, weight in zip(sources, weights or [1.0] * len(sources), strict=True):
        new = Wrapper.of("#root", [Page(source).root], weight)
        whole = merge(whole, new) if whole is not None else new
    return whole


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_marks_of_whole_pages_and_second_articles():
    body = "<h1>Title</h1><p>First words of it.</p><p>Second words of it.</p>"
    want = "Title\n\nFirst words of it.\n\nSecond words of it."
    assert main_text(f'<body><form action="x.aspx"><nav>Menu</nav><div>{body}</div><input></form></body>') == want
    assert main_text(f'<body><form><div class="box"><p>{"words " * 30}</p></div></form><div>{body}</div></body>') != ""
    assert main_text(f'<body><div class="page menu-open"><div>{body}</div></div></body>') == want
    more = '<section class="more"><article><h2>Teaser</h2><p>Read this too</p></article></section>'
    assert main_text(f"<body><main><article>{body}</article>{more}</main></body>") == want
    assert main_text(f"<body><article>{body}</article><article><p>Teaser</p></article></body>") == want
    comment = '<article class="comment"><p>I liked all of this so very much, dear author, go on like this</p></article>'
    assert main_text(f"<body><article>{body}</article>{comment * 5}</body>") == want
    slugs = f'{body}<section id="discussion"><h2 id="related-work">Related work</h2><p>Said.</p></section><div class="alert">Mind this</div>'
    assert main_text(f"<article>{slugs}</article>") == f"{want}\n\nRelated work\n\nSaid.\n\nMind this"
    assert main_text(f'<body><h1>Title</h1><div class="x"><p>First words of it.</p><p>Second words of it.</p></div><div id="cookie-bar">Yes</div></body>') == want


def test_wrapper_decides_without_tags_and_names():
    """No article element, no telling class: a page's own text is shorter than what varies little around it."""
    rng = random.Random(1)
    page = "<body><div><a href=/>Home</a> <a href=/a>{nav}</a></div><div>{aside}</div><div><p>{a}</p><p>{b}</p></div><div>All rights of {site} are reserved</div></body>"
    pages, wanted = [], []
    for i in range(30):
        n = 6 if i % 10 == 0 else 60
        a, b = _text(rng, n), _text(rng, n)
        pages.append(page.format(nav=f"Part {i}", aside=_text(rng, 14), a=a, b=b, site="this site and its many owners"))
        wanted.append(f"{a}\n\n{b}")
    wrapper = _induce(pages)
    assert [main_text(p, wrapper) for p in pages] == wanted
    alone = [main_text(p) for p in pages]
    assert sum(x != y for x, y in zip(alone, wanted, strict=True)) >= 3  # the short ones need the wrapper


def test_template_runs_by_place_share_and_distinct_pages(spark):
    page = "<body><ul><li><a>About</a></li></ul><div>{top}</div><div><p>About</p><p>Story {i} of a day that was long</p><p>{end}</p></div></body>"
    # one page words the template otherwise; a heading with the words of a menu entry stays
    rows = [(i, "http://h.org/", page.format(i=i, top="Top", end="Follow us on it" if i != 7 else "Folgt uns")) for i in range(40)]
    # copies of one page are one page
    same = "<body><div><p>Always the same words here</p><p>And these</p></div></body>"
    rows += [(100 + i, "http://same.org/", same) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for bound in (1 << 20, 0):
        got = {r.page_id: r.text for r in extraction.extract(df, bound).collect()}
        assert all(got[i] == f"Story {i} of a day that was long" + ("\n\nFolgt uns" if i == 7 else "") for i in range(40))
        assert all(got[100 + i] == "Always the same words here\n\nAnd these" for i in range(30))
    in_article = "<article><p>About</p><p>Story {i}</p></article>"
    wrapper = _induce([in_article.format(i=i) for i in range(20)])
    assert main_text(in_article.format(i=3), wrapper) == "About\n\nStory 3"


def test_nesting_of_any_depth(spark):
    deep = "<body>" + "<div>" * 5000 + "<p>deep</p><nav>menu<p>of it</p></nav><p>more</p>" + "</div>" * 5000 + "<footer>end</footer>"
    rows = [(1, "http://d.org", deep), (2, "http://d.org", "<div>" * 100_000 + "open"), (3, "http://d.org", "<p>" + "x " * 500_000), (4, None, "<"), (5, "u", "<ul><li>" * 3000 + "list")]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 0).collect()}
    assert got[1] == "deep\n\nmore" and got[2] == "open" and len(got[3]) == 999_999 and got[5] == "list"


def test_wrappers_stay_small():
    rng = random.Random(2)
    sizes = []

    def page():
        blocks = "".join(f'<div class="{rng.choice(WORDS)}"><p>{_text(rng, 3)}</p></div>' for _ in range(rng.randint(5, 25)))
        return f"<body><nav>x</nav>{blocks}<ul>{'<li>y</li>' * rng.randint(0, 5)}</ul></body>"

    whole = None
    for i in range(400):
        new = Wrapper.of("#root", [Page(page()).root], 1.0)
        whole = merge(whole, new) if whole is not None else new
        if i in (199, 399):
            sizes.append(len(extraction._dump(whole)))
    assert sizes[1] < 1.3 * sizes[0]
    runs = extraction.summary({k: 1.0 for k in range(1000)} | {5: 400.0})
    assert list(runs) == [5] and runs[5] >= 400 - 1399 / (extraction.RUNS + 1)


def test_pages_without_their_tags(spark):
    """The pages of sf0.1 with every telling tag and class made a plain div: pages alone go wrong, wrappers do not."""
    import html
    import re

    from sylvameter.sources.tables import table

    pages = {r.page_id: (r.url, r.html) for r in table(spark, "/root/testdata/sf0.1", "pages").collect()}
    bare = {k: (u, re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h).replace('class="ad"', 'class="x"')) for k, (u, h) in pages.items()}
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in bare.items()], "page_id long, url string, html string").repartition(4)
    got, wrong, alone = {r.page_id: r.text for r in extraction.extract(df).collect()}, 0, 0
    for k, (_, h) in pages.items():
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        want = "\n\n".join(b for b in blocks if b)
        wrong, alone = wrong + (got[k] != want), alone + (main_text(bare[k][1]) != want)
    assert wrong <= 2 and alone > 50


def test_names_count_as_a_whole():
    """A name tells only if all its words do; what it tells of sections holds inside an article too."""
    body = "<h1>Title</h1><p>First words of it.</p>"
    for name in ("share-price", "related-work", "notice-period", "social-comment", "advert-history", "promo-code-law", "no-ads", "history-of-comments"):
        assert main_text(f'<article>{body}<section class="{name}"><p>Kept.</p></section></article>').endswith("\n\nKept."), name
    for name in ("related-posts", "share-buttons", "ad", "x ad-slot-inline", "social-share", "comment-list", "newsletter-signup", "cookie-consent", "sidebar__x7"):
        assert "Cut" not in main_text(f'<article>{body}<section class="{name}"><p>Cut.</p></section></article>'), name


def test_formulas_and_fallbacks_are_text():
    page = '<article><p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation encoding="x">mc^2</annotation></math> holds</p><object><p>Seen.</p></object><svg><text>icon</text></svg></article>'
    assert main_text(page) == "E = mc2 holds\n\nSeen."


def test_short_story_beside_a_long_sidebar():
    side = f'<div class="sidebar"><p>{"many words of links and such " * 60}</p></div>'
    for story in ("<h2>A tale</h2><p>Short story here.</p>", "<h1>A tale</h1><p>Short story here.</p>"):
        assert main_text(f'<body>{side}<div class="x">{story}</div></body>') == "A tale\n\nShort story here."
    assert main_text(f'<body>{side}</body>') != ""  # around all there is, a mark says nothing


def test_many_siblings_take_linear_time(spark):
    """Ten thousand terms and meanings, headings and paragraphs, blocks of kinds of their own, and broken tags."""
    import string
    import time

    def kinds(k):
        names = ("".join(string.ascii_lowercase[i // 26**n % 26] for n in range(3)) for i in range(8000))
        return "".join(f'<div class="c{n}"><p>text number {i * k}</p></div>' for i, n in enumerate(names) if i % k)

    terms = "".join(f"<dt>term {i}</dt><dd>meaning {i}</dd>" for i in range(10_000))
    heads = "".join(f"<h3>head {i}</h3><p>par {i}</p>" for i in range(10_000))
    pages = [
        f"<body><dl>{terms}</dl></body>", f"<body><dl>{terms.replace('<dd>meaning 77</dd>', '')}</dl></body>", f"<body>{heads}</body>", f"<body>{heads}<p>more</p></body>",
        f"<body>{kinds(3)}</body>", f"<body>{kinds(5)}</body>", "<body><p>begin</p>" + "<script" * 50_000, "<body><p>begin</p>" + "<!-- x " * 100_000,
    ]
    began = time.perf_counter()
    rows = [(i, "http://long.org/", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.perf_counter() - began < 60
    assert got[0].count("\n\n") == 19_999 and got[3].count("\n\n") == 20_000 and got[4].startswith("text number 3") and got[6] == got[7] == "begin"


def test_kinds_in_their_longest_common_order():
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(200):
        left, right = (rng.sample("abcdefgh", rng.randint(0, 6)) + ["x"] * rng.randint(0, 2) for _ in range(2))
        pairs = extraction._in_order(left, right)
        assert all(left[i] == right[j] for i, j in pairs) and pairs == sorted(pairs) and sorted(j for _, j in pairs) == [j for _, j in pairs]
        once = [(i, right.index(k)) for i, k in enumerate(left) if left.count(k) == right.count(k) == 1]
        most = max(n for n in range(len(once) + 1) for c in combinations(once, n) if [j for _, j in c] == sorted(j for _, j in c))
        assert len(pairs) == most


def _texts(spark, rows, tasks):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(tasks)
    return {r.page_id: r.text for r in extraction.extract(df).collect()}


def test_nothing_is_forgotten_on_large_hosts(spark):
    """A template block on three of a host's pages is one on any number of pages and tasks; so is a run among many others."""
    rng = random.Random(7)

    def rows(host, n, first):
        out = []
        for i in range(n):
            note = "<div class='x'><h2>Special edition of the whole day</h2></div>" if i % (n // 3) == 0 and i < n - n % 3 else ""
            out.append((first + i, host, f"<body><div class='y'>Top</div><div class='z'>{note}<p>Story {i} {_text(rng, 40)}</p></div></body>"))
        return out

    small, large = rows("http://small.org/", 12, 0), rows("http://large.org/", 330, 1000)
    many = [(5000 + i, "http://many.org/", f"<body><div>{''.join(f'<p>{_text(rng, 9)} {i}</p>' for _ in range(40))}<p>Follow us on it</p></div></body>") for i in range(30)]
    once, twice = (_texts(spark, small + large + many, tasks) for tasks in (1, 5))
    assert once == twice
    assert not [k for k, t in once.items() if "Special edition" in t or "Follow us" in t]
    assert all(t.startswith("Story ") for k, t in once.items() if k < 5000)


def test_wrappers_count_exactly():
    """Groups on one page of many, and every run of a slot, whatever order the pages come in."""

    def groups(wrapper):
        return [wrapper] + [g for kid in wrapper.kids for g in groups(kid)]

    body = "<body>{a}<div><p>{t}</p><p>Always</p></div></body>"
    pages = [body.format(a="<ul><li>once</li></ul>" if i == 3 else "", t=f"text {i}") for i in range(200)]
    for order in (pages, pages[::-1]):
        whole = _induce(order)
        assert [g.pages for g in groups(whole) if g.kind == "ul"] == [1.0]
        counts = max((g.runs for g in groups(whole)), key=len)
        assert len(counts) == 201 and sorted(counts.values())[-2:] == [1.0, 200.0]


def test_matching_is_best_for_any_length():
    rng = random.Random(9)

    def table(left, right, score):
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + score(i, j) if x == y else 0)
        return best[-1][-1]

    for n, m in [(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(300)] + [(150, 400)]:  # 60,000 pairs of places
        left, right = ([rng.choice("abcde") for _ in range(k)] for k in (n, m))
        weights = {}

        def score(i, j):
            return weights.setdefault((i, j), 1 if left == right else rng.randint(1, 4))

        pairs = extraction.match(left, right, score)
        assert all(left[i] == right[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert sum(score(i, j) for i, j in pairs) == table(left, right, score)
