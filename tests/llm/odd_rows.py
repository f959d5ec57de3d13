"""Rows that every operator must take: nulls, empty and very long texts, ties and repeated rows."""

ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "a b"),
    (6, "a  b"),
    (7, "a b"),
    (None, "a b"),
    (8, "ünï çødé 🎉 " * 40),
    (9, "word " * 30_000),
    (10, "x" * 200_000),
    (11, "word " * 30_000),
    (11, "word " * 30_000),
]
