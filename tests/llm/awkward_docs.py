"""Documents with every awkward case: nulls in any column, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random


WORDS = "ant bee cat dog eel fox gnu hen ibis jay kite lynx mole newt owl pig quail rat seal toad".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", ""]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def awkward_rows():
    rng = random.Random(7)
    base = prose(rng, 90)
    near = base.replace("ant", "ants", 1)
    return [
        (0, base, "en", "s", 1), (1, base, "en", "s", 1), (2, near, None, None, None), (3, None, "de", "s", 0), (4, "", "de", "s", 0), (5, "", None, "s", 0),
        (6, prose(rng, 60), "de", "s", 1), (6, prose(rng, 70), "de", "s", 1), (7, "one line", "en", "s", 1), (7, "one line", "en", "s", 1), (None, prose(rng, 50), "en", "s", 1),
        (8, "   \n\t ", "fr", "s", 3), (9, "x" * 70_000, "fr", "s", 3), (10, prose(rng, 9000), "fr", "s", 3), (11, "!!! ... 123", "fr", "s", 3), (12, "éü中文 \U0001f600 İstanbul", "fr", "s", 3),
        (-5, base + " and more of it", "en", "s", 1), (13, "<|endoftext|> <|STARTOFTEXT|> a.b, c.", "en", "s", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
