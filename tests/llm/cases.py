"""Small tables with the awkward rows every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, base string"


def edge_documents(spark, texts=None):
    texts = texts if texts is not None else EDGE_TEXTS
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


EDGE_TEXTS = [
    None,
    "",
    " ",
    "  a",
    " a b",
    "a  b\n c",
    "x<|endoftext|> y <|endoftext|>",
    "<|startoftext|>Hello",
    "it's 12 a1b2.  x　y",
    "\n\n",
    "é ́ é x ́y",
    "Σας ΟΔΟΣ Σ. a",
    "a.. b,. c\r\nd\te",
    "don't. 's 'S can't've",
    "a\x1cb \x1c c",
    "ǅ. ²³. x²,",
    "«…. «a».'" * 3,
    "word " * 3000,
    "x" * 5000,
    "naïve über straße the the THE The.\nNext line, and more.\nÉtat",
    "Hello world. Hello world.",
    "Hello world. Hello world.",
]
