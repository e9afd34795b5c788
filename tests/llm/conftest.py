from __future__ import annotations

import random

import pytest

EMPTY_DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def corpus():
    """Small documents with nulls, blanks, exact and near copies, shared passages and a very long text: (doc_id, text)."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, base = line(60), line(200)
    near = base.split()
    near[50] = "changed"
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, " ".join(near)), (6, base.upper()), (7, line(40) + "\n" + passage + " " + line(30)), (8, passage + " " + line(5)), (9, line(3)), (10, line(34)), (11, line(35))]
    rows += [(12, (line(20) + " ") + (passage + " ") * 2 + line(20)), (13, "x"), (14, line(9000)), (15, "ñandú Straße 12 ¡qué! " * 30), (16, "日本語 текст 漢字")]
    rows += [(i, line(rng.randint(1, 120))) for i in range(17, 60)]
    rows += [(60, base)] * 2
    return rows
