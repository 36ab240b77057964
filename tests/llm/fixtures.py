"""Documents that hold nulls, ties, repeats, empty and long texts and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, text2 string"


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "and", "éa", "Zwei", "naïve", "x", "漢字", "don't", "#tag", "*", "re", "ti", "on", "wh", "er"]
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 120))))
    for i in range(0, n, 6):
        w = out[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(out[i])
    return [*out, None, None, "", " \t\n", "one", "two words", "a" * 3000, "ab" * 2000, "ß wide space", "▁mark ▁▁ x", "\x00\x01", " ".join(["long"] * 5000)]


def rows(n=60, seed=3):
    t = texts(n, seed)
    got = [(i, x, None if i % 7 == 3 else ("en", "fr")[i % 2], None if i % 11 == 5 else f"s{i % 3}", len(x or ""), i, -i, "clash") for i, x in enumerate(t)]
    return got


def documents(spark, n=60, seed=3):
    return spark.createDataFrame(rows(n, seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
