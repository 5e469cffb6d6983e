"""Documents with everything that can go wrong in a row."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept string, size string, digest string, node int, range int"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; every row has extra, clashing columns."""
    extra = ("k", "s", "d", 1, 2)
    long_text = prose(1, 30_000, 10**6)
    rows = [
        (1, prose(2, 120), "en", "a", 10),
        (1, prose(2, 120), "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \n\t ", "en", None, 4),
        (None, prose(3, 80), "en", "a", 5),
        (None, None, None, None, None),
        (5, "word", "de", "b", 4),
        (6, "word", "de", "c", 4),
        (7, long_text, "en", "c", len(long_text)),
        (8, "a" * 3_000, "en", "c", 3_000),
        (9, "äöü ßéñ 日本語 👍 " * 20, "fr", "é", 1),
        (10, prose(2, 120) + " tail", "en", "b", 10),
        (-5, prose(4, 60), "en", "a", 1),
        (2**60, "last one\nlast one\n", "en", "a", 1),
        (11, "\x00 odd \x1c\x85\xa0 spaces  x ", "en", "a", 1),
    ]
    return [(*row, *extra) for row in rows]
