"""A small corpus with the odd cases every operator must take: nulls, blanks, ties, repeats, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def made(n=160, seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Idiot", "naïve", "日本", "x1", "end.", "a,b", "'s"] + ["".join(rng.choice("abcdeß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    lines = [" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(3)]
    rows = []
    for k in range(n):
        body = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 12))]
        if k % 7 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        if k % 5 == 0:
            body += lines
        if k % 11 == 0:
            body += ["", "  \t"] + body[:2]
        text = rng.choice(["\n", "\n", " \n"]).join(body)
        rows.append((k * 3, text, rng.choice(["en", "fr", None]), "hot" if k % 3 else rng.choice(["s1", "s2", "ü", None]), len(text)))
    rows += [(1000, rows[3][1], "en", "hot", 1), (1001, rows[3][1] + " x", "en", "s1", 1), (1002, None, "en", "hot", None), (1003, "", "en", "s1", 0), (1004, " \n\t ", "en", "s2", 4)]
    rows += [(1005, "one", "en", "hot", 3), (1006, " ".join(rng.choice(vocabulary) for _ in range(9000)), "en", "hot", 1), (-7, rows[0][1], "en", None, 1)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(made() if rows is None else rows, SCHEMA)


def clashing(df):
    """df with columns named as operators name their own."""
    from pyspark.sql import functions as F

    for name in ("size", "h", "bucket", "starts", "ends", "_key", "_salt", "rank", "curve", "print", "part", "fingerprint", "score", "left", "copies", "row", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df
