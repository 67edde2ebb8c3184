"""Texts that every operator must take."""

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t\n "), (4, "one"), (5, "same text here for all"), (6, "same text here for all"), (6, "same text here for all"),
       (None, "no id at all"), (None, None), (7, LONG), (8, "漢字 😀 é\x0b\x1cz\xa0q r"), (9, "a\n\nb\na\nb")]
