"""Places where an operator once did less than the whole job."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from corvia.llm import html_tree, jaccard


def test_copies_keep_their_article(spark):
    item = "<html><body><article><h1>Title</h1>{}</article></body></html>"
    copied = item.format("<ul><li>first item</li><li>second item</li></ul><section><p>closing words</p></section>")
    near = [item.format(f"<div><p>shared words</p><b>own {i}</b></div>") for i in range(5)]
    other = [item.format(f"<p>body of page {i}</p><p>Follow us</p>") for i in range(8)]
    pages = [copied] * 6 + near + other
    rows = [(i, f"http://h.x/{i}", x) for i, x in enumerate(pages)] + [(100 + i, f"http://copies.x/{i}", copied) for i in range(5)]
    # On a host where every article says it, it is template as before.
    rows += [(200 + i, f"http://t.x/{i}", f"<article><h1>Head {i}</h1><p>Text {i}</p><p>Follow us</p></article>") for i in range(8)]
    got = {r.page_id: r.text for r in html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "first item second item closing words"
    assert all(got[i].endswith(whole) for i in range(6)) and {got[100 + i] for i in range(5)} == {f"Title {whole}"}
    assert all(got[6 + i].endswith(f"shared words own {i}") for i in range(5))
    assert all(got[11 + i].endswith(f"body of page {i} Follow us") for i in range(8))
    assert all(got[200 + i] == f"Head {i} Text {i}" for i in range(8))


def candidates(u, v, num, den):
    """Whether two sets alone in a table come to be compared, by the rule of jaccard_components."""
    (a, need_a), (b, need_b) = (jaccard.signatures(s, num, den) for s in (u, v))
    met = Counter(int(key) & 1 for key in set(a.tolist()) & set(b.tolist()))
    return any(c >= need_a[odd] and c >= need_b[odd] for odd, c in met.items())


@pytest.mark.parametrize(("num", "many"), [(80, 400), (90, 4000)])
def test_every_linked_pair_is_a_candidate(num, many):
    rng = np.random.default_rng(1)
    pairs, lost = 0, []
    for size in range(6, 31):
        for other in range(size, 31):
            same = -(-num * (size + other) // (100 + num))  # the least overlap that links
            if same > size or same == other:
                continue
            for _ in range(many // 25):
                drawn = rng.integers(0, 1 << 64, size + other - same, dtype=np.uint64)
                u, v = np.sort(drawn[:size]), np.sort(drawn[size - same :])
                assert len(v) == other and 100 * same >= num * len(drawn)
                pairs += 1
                if not candidates(u, v, num, 100):
                    lost.append((size, other))
    assert pairs > many and lost == []
