"""Pages whose marks are absent or wrong: the cut against what the marks alone tell."""

import random
import re
import time

import pytest

from tidemark.llm import mincut

from .data import prose


def sentence(r, n):
    return re.sub(r"\d+", "", prose(r.randint(0, 10**6), n)).capitalize() + "."


ADVERTS = ["Buy now and save 50% off this week only.", "Sponsored: sign up today for a free trial, limited offer.", "Best deals on sale, order now, free shipping."]
NOTICES = ["We use cookies. Accept all or decline.", "This site uses cookies. Read our privacy policy. Accept.", "Subscribe to our newsletter. Sign up."]


def page(r, kind):
    """(html, the article's text)."""
    blocks = [sentence(r, r.randint(15, 60)) for _ in range(r.randint(3, 6))]
    paragraphs = "".join(f"<p>{b}</p>" for b in blocks)
    text = " ".join(blocks)
    if kind == "advert in article":
        k = r.randint(1, len(blocks) - 1)
        inner = "".join(f"<p>{b}</p>" for b in blocks[:k]) + f"<div><p>{r.choice(ADVERTS)}</p></div>" + "".join(f"<p>{b}</p>" for b in blocks[k:])
        return f"<body><article>{inner}</article></body>", text
    if kind == "advert without article":
        return f"<body><div>{paragraphs}<p>{r.choice(ADVERTS)}</p></div></body>", text
    if kind == "notice before":
        return f"<body><div><p>{r.choice(NOTICES)}</p></div><article>{paragraphs}</article></body>", text
    if kind == "notice in main":
        return f"<body><main><p>{r.choice(NOTICES)}</p>{paragraphs}</main></body>", text
    if kind == "comments after":
        said = "".join(
            f"<div><p>{r.choice(['Anna', 'Bob'])} wrote {r.randint(2, 9)} days ago</p><p>{sentence(r, r.randint(3, 9))}</p><p>Reply</p></div>" for _ in range(r.randint(2, 4))
        )
        return f"<body><div>{paragraphs}</div><div><p>{r.randint(2, 9)} comments</p>{said}<p>Leave a comment</p></div></body>", text
    if kind == "references":
        names = [f"{sentence(r, 1)[:-1]} {r.randint(1950, 2020)}, {sentence(r, 4)}" for _ in range(r.randint(2, 5))]
        items = "".join(f'<li><a href="#{k}">{n}</a></li>' for k, n in enumerate(names))
        return f"<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article>{paragraphs}<ul>{items}</ul></article></body>", f"{text} {' '.join(names)}"
    if kind == "plain text":
        lines = [" ".join(b[:-1].split()) for b in blocks]
        return "<div>" + "</div><div>".join(lines) + "</div>", " ".join(lines)
    return f"<body><div><ul><li><a href=x>Home</a></li><li><a href=y>All news</a></li></ul></div><div>{paragraphs}</div></body>", text


KINDS = ["advert in article", "advert without article", "notice before", "notice in main", "comments after", "references", "plain text", "links without marks"]


def by_marks(html):
    """What the elements around a block say, alone; without any mark of content, all that isn't marked."""
    found = mincut.blocks(html)
    total = mincut.shares(found)
    known = {}
    around = [mincut.side(b.node, total, known) for b in found]
    return " ".join(b.text for b, s in zip(found, around, strict=True) if s == 1 or s == 0 and 1 not in around)


def by_costs(html):
    """The classifier without neighbours."""
    found = mincut.blocks(html)
    total = mincut.shares(found)
    known = {}
    return " ".join(b.text for b in found if (s := mincut.side(b.node, total, known)) != -2 and mincut.score(b, s) > 0)


def test_the_cut_beats_marks_and_costs_alone():
    r = random.Random(21)
    pages = [(kind, *page(r, kind)) for kind in KINDS for _ in range(25)]
    right = {way.__name__: {kind: sum(way(html) == text for k, html, text in pages if k == kind) for kind in KINDS} for way in (mincut.main_text, by_marks, by_costs)}
    total = {name: sum(x.values()) for name, x in right.items()}
    print(right)
    # of 200: figures in the README
    assert total["main_text"] >= 195
    assert total["by_marks"] <= 80
    assert total["by_costs"] < total["main_text"] - 20
    assert min(right["main_text"].values()) >= 22


def test_a_cue_in_a_long_paragraph_costs_little():
    text = sentence(random.Random(1), 60) + " They buy now and then, and like what he says."
    assert mincut.main_text(f"<article><p>{text}</p></article>") == text
    assert mincut.cues("Reply") == 1 and mincut.cues("nothing of the kind") == 0 and mincut.cues("") == 0


@pytest.mark.parametrize("shape", ["<div>some text here. ", "<div>x.</p>", "</b></i></nav><div>x. "])
def test_deep_pages_take_linear_time(shape):
    def seconds(n):
        start = time.process_time()
        mincut.main_text(shape * n)
        return time.process_time() - start

    seconds(500)
    assert seconds(20_000) < 30 * max(seconds(2_000), 0.02)
