"""Rows that operators must take: nulls, empty and long texts, ties and repeated rows."""

NASTY = [
    (5, "The quick brown fox jumps over the lazy dog. " * 3, "en"),
    (3, None, "en"),
    (9, "", None),
    (9, "", None),
    (7, "  \n\t  ", "en"),
    (1, "12345 !!! ???", "de"),
    (2, "Größe und Maß, café — naïve 😀 é", "de"),
    (None, "a text whose id is null", "en"),
    (8, "word " * 40_000, "en"),
    (4, "x" * 30_000, None),
    (6, "The quick brown fox jumps over the lazy dog. " * 3, "en"),
    (6, "The quick brown fox jumps over the lazy dog. " * 3, "en"),
    (10, "a", "fr"),
]
CLASHING = "doc_id long, text string, lang string, score double, start string, length int, id string, key string, n_tokens int, kept int, class_id int, run int, n int"
