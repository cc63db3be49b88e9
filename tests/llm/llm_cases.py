"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random
import re

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, row string, size int, "
          "kept boolean, fp long, h1 long, key string, grp long, pos int, norm string, salt int, copies int, page_id long")
EXTRA = (7, "r", 3, True, 9, 9, "k", 1, 2, "n", 4, 5, 6)


def rows(texts: list[tuple]) -> list[tuple]:
    """(doc_id, text, source) with everything else filled in."""
    return [(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in texts]


def edge_texts() -> list[tuple]:
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "Überfluß", "délta", "eps", "zéta", "漢字", "x", "😀"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = some(60), "This line is shared by very many documents, as licences are"
    out = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "no id at all, but a text", "b"), (None, None, None),
        (4, "Same TEXT here", "a"), (5, "same text HERE", "b"), (6, "same text here ", "b"), (5, "same text HERE", "b"),
        (7, "one", "c"), (8, "one two", "c"), (9, "line\r\nbreaks\n\n\nand\ttabs\x0bhere\n", "c"),
        (10, "İ dotted, ﬁ ligature, \x00 zero, \x85 next line, \xa0 hard space", "c"),
        (11, "12345 !!! ???", "a"), (12, some(20_000), "a"), (13, "w" * 50_000, "b"),
    ]
    out += [(20 + i, f"{some(5)} {passage} {some(5 + i)}", "a") for i in range(6)]
    out += [(40 + i, f"{some(12)}\n  {line.upper() if i % 2 else line}\t\n{some(8)}", "big") for i in range(9)]
    out += [(60 + i, "A copy that a third of all rows are, word for word, without any change at all.", "big") for i in range(30)]
    out += [(100 + i, some(rng.randint(1, 80)), "big") for i in range(40)]
    return out


def words(text: str | None) -> list[str]:
    return re.findall(rf"[^{SPACES}]+", text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
