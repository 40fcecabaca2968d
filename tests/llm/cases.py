"""Documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, raw string, start string"


def awkward(spark, extra=()):
    rng = random.Random(5)
    words = ["the", "of", "edouti", "Thorreou", "onerth,", "ndblé", "straße", "ação", "42", "x_y", "don't", "END."]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = {
        0: None,
        1: "",
        2: " ",
        3: "\n\n",
        4: "a",
        5: "Hello  world\t\t foo<|endoftext|> bar <s> </s>",
        6: "Á é ﬁ   nbsp   em \x1c fs 　x",
        7: long,
        8: "x" * 5000,
        9: "日本語のテキスト 中文 текст על",
        10: "same text here for ties",
        11: "same text here for ties",
        12: "don't we'll I'M  ...  !!'s 'stop' 1234 ²³ 💥💥 \x00 nul ▁ low ▁▁x",
        13: "\r\n line\x0b\x0c two \x85 nel",
        **dict(enumerate(extra, 20)),
    }
    rows = [(k, t, "en" if k % 3 else None, "s", None if t is None else len(t), "k", "h", "r", "s") for k, t in texts.items()]
    rows += [rows[10], rows[10], (None, "no id", None, None, 5, "k", "h", "r", "s"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
