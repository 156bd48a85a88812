"""Texts and rows that the operators have to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, `text.1` int, key string"


def rows(seed=1, n=60):
    """Documents with nulls, empty, odd and long texts, ties, repeated rows and clashing columns."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ñ", "the", "The", "\x1cx", "y\x85z", "日本"]
    passage = " ".join(rnd.choice(words) for _ in range(70))
    line = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(5)]
    out = []
    for k in range(n):
        text = " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", "\n", "\t", "  "]) for _ in range(rnd.randrange(1, 160)))
        if k % 4 == 1:
            text = text[: len(text) // 2] + " " + passage[rnd.randrange(40) :] + " " + text[len(text) // 2 :]
        if k % 5 == 2:
            text += "\n" + "\n".join(line[rnd.randrange(2) :])
        if k % 9 == 4:
            text = out[rnd.randrange(len(out))][1] or ""
        out.append((1000 - 7 * k, text))
    out += [(3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "Two words"), (8, "x " * 5000), (8, "other text of the same id"), (9, "a\n\n\n\nb\n\n\n"), (9, "a\n\n\n\nb\n\n\n"), (None, passage), (10, "!!! ... 123")]
    return [(i, t, "en", "s", len(t or ""), "clash", 1, None) for i, t in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
