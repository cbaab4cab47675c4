"""The site style tree against a plain one, and pages of odd form."""

from __future__ import annotations

import math
import random
import time
import tracemalloc
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corvia.llm import html_tree as t

SCHEMA = "page_id long, url string, html string"


def entropy(counts):
    m = sum(counts.values())
    return 1.0 if m == 1 else min(1.0, -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(min(m, 64)))


def plain_texts(pages, share=0.2, content=0.3, strict=0.02, presentation=0.5, lean=8.0):
    """[(url, html)] -> texts, by dictionaries over all pages."""
    parsed = [(t.host_of(u), *t.parse(h or "")) for u, h in pages]
    places, have, styles, seen, units = {}, Counter(), defaultdict(Counter), defaultdict(set), defaultdict(set)
    for number, (host, blocks, elements) in enumerate(parsed):
        article = t.article_of(blocks)
        units[host].add(article)
        for key, e in {(host, e.place.path): e for e in reversed(elements)}.items():
            places[key] = e.place
            have[key] += 1
            styles[key][tuple(e.children)] += 1
        for place, text in blocks:
            seen[host, place.path, text].add(("a", article) if place.sealed else ("p", number))
    own_chars, own_mass, importance = Counter(), Counter(), {}
    for (host, path, text), who in seen.items():
        m = len(units[host]) if places[host, path].sealed else have[host, path]
        x = max(0.0, 1 - math.log(len(who)) / math.log(m)) if m > 1 else 1.0
        importance[host, path, text] = x
        own_chars[host, path] += len(who) * len(text)
        own_mass[host, path] += len(who) * len(text) * x
    look = {k: entropy(v) for k, v in styles.items()}
    pooled = defaultdict(Counter)
    for (_, path), v in styles.items():
        pooled[path].update(v)
    look_all = {k: entropy(v) for k, v in pooled.items()}
    chars, mass, variety, variety_all, holds = Counter(), Counter(), defaultdict(float), defaultdict(float), defaultdict(bool)
    for (host, path), place in places.items():
        for up in (*(a.path for a in place.above), path):
            key = host, up
            chars[key] += own_chars[host, path]
            mass[key] += own_mass[host, path]
            variety[key] = max(variety[key], look[host, path])
            variety_all[key] = max(variety_all[key], look_all[path])
            holds[key] |= place.sealed
    total = defaultdict(lambda: [0, 0])
    for key in places:
        for i, x in enumerate((mass[key], have[key])):
            total[key[1]][i] += x
    figure = {}
    for key, place in places.items():
        m, (w, n) = have[key], total[key[1]]

        def blend(here, everywhere, m=m):
            return ((m - 1) * here + lean * everywhere) / (m - 1 + lean)

        leaning = (mass[key] + lean * w / n) / (m + lean)
        frame = not place.sealed and (place.tag in ("", "html", "body") or blend(look[key], look_all[key[1]]) < presentation)
        figure[key] = chars[key] / m, mass[key] / m, leaning * (t.SLOT + (1 - t.SLOT) * blend(variety[key], variety_all[key])) * place.hint, frame
    beside = defaultdict(list)
    for (host, path), place in places.items():
        if place.above:
            beside[host, place.above[-1].path].append((host, path))
    low = set()
    for parent, children in beside.items():
        best, named = max(figure[k][2] for k in children), any(holds[k] for k in children)
        for key in children:
            c, w, weight, _ = figure[key]
            place = places[key]
            open_ = all(figure[key[0], a.path][3] for a in place.above)
            scale = t.HINT if named and not holds[key] else 1.0
            if open_ and place.tag not in t.HEADINGS and not holds[key] and weight * scale < share * best:
                low.add(key)
            if place.hint * w < content * c and 2 * c < figure[parent][0]:
                low.add(key)
    out = []
    for host, blocks, elements in parsed:
        kept = []
        for place, text in blocks:
            key = host, place.path
            single = importance[(*key, text)] < strict and mass[key] >= t.VARIED * chars[key]
            if not single and not any((host, x.path) in low for x in (*place.above, place)):
                kept.append(text)
        if not kept and not any(e.place.sealed for e in elements):
            kept = [text for _, text in blocks]
        out.append(" ".join(kept))
    return out


def made_pages(seed, n=160):
    rng = random.Random(seed)
    word = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(k))
    pool, shared = [word(6) for _ in range(12)], [word(30) for _ in range(3)]
    pages = []
    for i in range(n):
        host = rng.choice(["a.x", "a.x", "a.x", "b.x", "c.x", f"one{i % 5}.x"])
        paragraphs = "".join(f"<p>{word(rng.randint(1, 40))}</p>" for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.3:
            paragraphs += f"<p>{rng.choice(shared)}"
        offer = f"<div class=offer><span>{rng.choice(pool[:2])}</span></div>" if rng.random() < 0.7 else ""
        body = f"<h1>{word(4)}</h1>{paragraphs}{offer}"
        if host == "b.x":
            body = f"<div id=top>{rng.choice(pool)}</div><div id=page><div class=text>{body}</div><div class=side>{rng.choice(pool)}</div></div>"
        else:
            body = f"<nav>{word(3)}</nav><div class=offer>{rng.choice(pool)}</div><article>{body}</article><div>{rng.choice(pool)}</div>"
        pages.append((i, f"http://{host}/{i}", f"<html><body>{body}<footer>f</footer></body></html>"))
    return pages


def test_texts_equal_a_plain_tree(spark):
    for seed, limits in ((1, {}), (2, {"share": 0.5, "content": 0.6, "strict": 0.2, "presentation": 0.3, "lean": 3.0})):
        pages = made_pages(seed)
        want = plain_texts([p[1:] for p in pages], **limits)
        for few in (300_000, 0):  # both ways to bring what goes to the pages
            got = {r.page_id: r.text for r in t.main_text(spark.createDataFrame(pages, SCHEMA), **limits, few=few).collect()}
            assert [got[p[0]] for p in pages] == want
    assert sum(a != b for a, b in zip(want, plain_texts([p[1:] for p in pages], share=0, content=0, strict=0), strict=True)) > 100


def test_tables_pages_equal_a_plain_tree_and_are_decided_by_it(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = [(r.page_id, r.url, r.html) for r in df.collect()]
    got = {r.page_id: r.text for r in t.main_text(df).collect()}
    assert [got[p[0]] for p in pages] == plain_texts([p[1:] for p in pages])
    without = {r.page_id: r.text for r in t.main_text(df, share=0.0, content=0.0, strict=0.0).collect()}
    assert sum(got[k] != without[k] for k in got) > len(got) / 2


def test_adverts_of_any_name_go_and_good_sections_of_any_name_stay(spark):
    rng = random.Random(5)
    word = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    rows = []
    for i in range(40):
        legal = f"<section class='legal tags related'><p>own{i} {word(9)}</p></section>"
        text = "".join(f"<p>{word(12)}</p>" for _ in range(1 + i % 6))
        rows.append((i, f"http://h.x/{i}", f"<body><article><h1>{word(3)}</h1>{text}{legal}<div class=zq>Buy now {i % 2}</div></article></body>"))
    for r in t.main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        assert "Buy now" not in r.text and f"own{r.page_id}" in r.text


def test_nesting_costs_no_more_than_its_length():
    def cost(n):
        source = "".join(f"<div class=c{i % 7}>" for i in range(n)) + "<p>deep</p>" + "</div>" * n + "<p>after</p>"
        tracemalloc.start()
        at = time.perf_counter()
        blocks, elements = t.parse(source)
        seconds, peak = time.perf_counter() - at, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [x for _, x in blocks] == ["deep", "after"] and len(elements) == n + 3
        assert all(len(e.place.above) <= t.DEPTH for e in elements)
        return seconds, peak

    (a, small), (b, large) = cost(10_000), cost(40_000)
    assert large < 6 * small and b < 12 * a + 1


def test_long_pages_repeated_rows_and_clashing_names(spark):
    long = "<article><p>" + "word &amp; " * 400_000 + "</p><p" + " x" * 300_000 + ">" + "y" * 2_000_000 + "</article>"
    rows = [(1, "http://a.b/1", long), (1, "http://a.b/1", long), (1, "http://a.b/2", "<p>other"), (None, None, "<p>no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("page", "blocks", "node", "text", "host", "a.b"):
        df = df.withColumn(name, F.lit(0))
    got = sorted((r.text[:9], r.n_chars) for r in t.main_text(df).collect())
    n = len("word & ") * 400_000 + 2_000_000
    assert got == [("no id", 5), ("other", 5), ("word & wo", n), ("word & wo", n)]
