"""Block rules against a plain two-pass version, on generated pages, and in linear time."""

import random
import time

from ledgerloom.llm import html_extract as h

PROSE = "this is the story of a river and it runs by the old mill on its way to the sea, as they say"


def plain_labels(blocks):
    """The labels by looking at every other block of the container."""
    decided = [h.first_pass(b) for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        if decided[i] is not None:
            out.append(decided[i])
            continue
        near = {v: min((abs(i - j) for j, o in enumerate(blocks) if o.box == b.box and decided[j] is v and not o.dropped), default=None) for v in (True, False)}
        if near[True] is None or near[False] is None:
            out.append(b.main if near[True] is near[False] else near[True] is not None)
        else:
            out.append(near[True] <= near[False])
    return out


def page(r, depth=0):
    out = []
    for _ in range(r.randint(1, 5)):
        kind = r.random()
        if kind < 0.3:
            out.append(f"<p>{PROSE * r.randint(1, 2)}</p>")
        elif kind < 0.45:
            out.append(f"<p>{r.choice(['Short.', 'Buy now', 'x'])}</p>")
        elif kind < 0.6:
            out.append(f"<p><a href=x>{r.choice(['Home', PROSE])}</a></p>")
        elif kind < 0.7:
            out.append(f"<p>{'zq ' * r.randint(1, 40)}</p>")
        elif depth < 4:
            tag = r.choice(["div", "section", "article", "aside", "nav", 'div class="comments"', "ul", "b", "span"])
            out.append(f"<{tag}>{page(r, depth + 1)}" + f"</{tag.split()[0]}>" * (r.random() < 0.9))
    return "".join(out)


def test_labels_against_all_neighbours():
    r = random.Random(5)
    seen = {True: 0, False: 0}
    for _ in range(400):
        blocks = h.blocks_of(page(r))
        decided = [h.first_pass(b) for b in blocks]
        got = h.second_pass(blocks, decided)
        assert got == plain_labels(blocks)
        for d, g in zip(decided, got, strict=True):
            if d is None:
                seen[g] += 1
    assert min(seen.values()) > 50


def test_deep_and_stray_tags_in_linear_time():
    begin = time.time()
    for text in ("<div>" * 20_000, "<div><b>" * 10_000 + "<li>x</li>" * 10_000, "<b>" * 20_000 + "</p>" * 20_000, "<p>x" * 20_000, "<ul>" * 5000 + "<li>a" * 5000 + "</ul>" * 5000, "</div>" * 20_000):
        h.main_text(text)
    assert time.time() - begin < 20


def test_repeated_rows_and_long_pages(spark):
    long = "<article>" + f"<p>{PROSE}.</p>" * 3000 + "</article>"
    rows = [(1, "u", long), (1, "u", long), (2, None, "<p>x"), (None, "u", None)]
    got = h.extracted(spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got) == [(0, 0), (1, 3000 * (len(PROSE) + 2) - 1), (1, 3000 * (len(PROSE) + 2) - 1), (2, 0)]
