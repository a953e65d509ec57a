"""Rows that every operator must live with."""

#: Null and empty texts, blanks only, one word, ties, repeated rows, a null id, a very long text, odd characters.
ROWS = [
    (1, None), (2, ""), (3, " \t\r\n "), (4, "One"), (5, "same words here and there again"), (6, "same words here and there again"), (7, "same words here and there again"),
    (7, "same words here and there again"), (None, "no id at all but words enough to count"), (None, None), (8, "x" * 70_000), (9, "word " * 30_000),
    (10, "ligne première\n\nΩ漢字\U0001f600 \x00\x0b end"), (11, "<a href='"), (12, "12345 67890 !!! ???"),
]
