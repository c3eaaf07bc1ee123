"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, sha string, h long, uid string, part string, ids string, label string"


def frame(spark, rows, extra: bool = True):
    """rows of (doc_id, text) as a documents table; further columns carry names used inside operators."""
    full = [(i, t, "en", "s", len(t or ""), "n", "s", 1, "u", "p", "i", "l") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and white texts, ties, repeated rows, long words, rare characters."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one two three four five"), (6, "one  two\tthree four five"),
            (7, "ONE two three four five"), (None, "one two three four five"), (None, None), (8, "x" * 3000), (9, "ä汉字 <|endoftext|> ▁ \x1c\x85 'll don't  "),
            (10, "mit license mit license " * 40), (11, " ".join(f"w{i}" for i in range(4000)))]


def near_copies(seed: int = 1, groups: int = 6, members: int = 14, words: int = 120) -> list[tuple[int, str]]:
    """Groups around a base text, each member with one or two words exchanged, and texts apart."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        out.append(" ".join(base))
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(words)] = word()
            out.append(" ".join(own))
    out += [" ".join(word() for _ in range(rng.randint(1, words))) for _ in range(30)]
    rng.shuffle(out)
    return list(enumerate(out))
