"""Rows that every text operator must take: nulls, ties, repeats, odd and very long texts."""

LONG = " ".join(f"word{i % 977} of line{i % 31}" for i in range(40_000))
TEXTS = [
    (1, "The cat sat on the mat, and the dog's 12 bones weren't there."),
    (2, None),
    (3, ""),
    (4, "   \n\t  "),
    (5, "x" * 30_000),
    (6, LONG),
    (7, "naïve café — 東京 😀 á   non​breaking\r\n\r\n  two  spaces "),
    (8, "<|endoftext|>in the<|endoftext|><|endoftext|> middle <|endoftext|"),
    (9, "The cat sat on the mat, and the dog's 12 bones weren't there."),
    (None, "a row without an id"),
    (1, "a second row of id one"),
    (10, "'s 're!!! don't  'll ''ve\n\n\n3.14159 100,000 ++--== \x00\x1f end"),
]


def frame(spark, rows=None, schema="doc_id bigint, text string, key string, id string, score string, lang string"):
    """The rows with extra columns whose names clash with inner ones."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "k", "i", "s", "en") for i, t in rows], schema)
