import random

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "ti", "vo", "zu") for c in ("", "n", "st", "l")]


def prose(seed, n, words=WORDS):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) for _ in range(n))


def docs(spark, rows, **extra):
    """doc_id, text, lang, source with clashing extra columns."""
    full = [(i, t, lang, src, 1, "x", 2.0) for i, t, lang, src in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score int, keep string, n_tokens double")


ODD = [(None, "no id here", "en", "s"), (90, None, "en", "s"), (91, "", None, None), (92, "   \n ", "en", "s"), (93, "...", "en", "s"), (94, "one", "en", "s"), (94, "one", "en", "s"), (95, "long " * 60_000, "en", "s")]
