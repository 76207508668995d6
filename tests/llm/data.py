"""Small tables for the tests: texts of every odd kind, and plain versions of what the operators define."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, kept boolean, `key` string"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "te", "ru", "so", "ne", "pa") for b in ("", "ra", "ti", "mon", "vel", "x,", "lé.")]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, len(text or ""), 7, 7, True, "k")


def prose(rng: random.Random, n: int) -> str:
    return "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(min(14, n - i))) for i in range(0, n, 14))


def odd_rows() -> list[tuple]:
    """Null, empty, blank and very long texts, repeated rows, ties, null ids, and columns of clashing names."""
    rng = random.Random(3)
    rows = [row(i, prose(rng, rng.randrange(55, 160)), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None])) for i in range(60)]
    base = rows[5][1]
    rows += [row(100, None), row(101, ""), row(102, " \t\n "), row(103, "one"), row(104, prose(rng, 30_000)), row(105, base), row(106, base), row(107, base.replace("ka", "KA", 1))]
    rows += [row(108, base + " tail"), row(7, rows[7][1], rows[7][2], rows[7][3]), row(None, prose(rng, 70), None, None), row(109, "aa " * 900), row(110, "x" * 50_000), row(111, "día\x85ñ b \U0001f600 " * 20)]
    return rows
