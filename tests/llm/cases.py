"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeét") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b = text(60), text(400)
    near = a.split()
    near[30] = "changed"
    out = [
        (1, a, "en", "s1"),
        (2, a, "en", "s1"),
        (3, " ".join(near), "en", "s2"),
        (4, b, "fr", None),
        (5, "", "en", "s2"),
        (6, None, "en", "s3"),
        (7, "one two", "en", "s3"),
        (8, "One  TWO", "en", "s3"),
        (9, "mail bob@example.com or +1 (487) 555-7209, card 4111 1111 1111 1111, host 10.0.0.255 and 300.1.1.1; later (487) 555-7209 again", "en", "s1"),
        (9, "mail bob@example.com or +1 (487) 555-7209, card 4111 1111 1111 1111, host 10.0.0.255 and 300.1.1.1; later (487) 555-7209 again", "en", "s1"),
        (None, "no id here but several words to count in this text", "en", "s1"),
        (None, None, None, None),
        (12, "Licensed under CC BY-NC 4.0. cc by cc by\nAll rights reserved. GNU General Public License, version 3 or later", "en", "s2"),
        (13, " ".join(word() for _ in range(20000)), "de", "s9"),
        (14, "éß \x00\t\r\n 日本語 😀   x", "ja", "s9"),
        (15, "same line\n" * 30 + "last", "en", "s2"),
    ] + [(100 + i, text(r.randint(5, 80)), "en", f"s{i % 4}") for i in range(60)]
    return [(*x, None if x[1] is None else len(x[1])) for x in out]


def frame(spark):
    """The cases, with further columns that operators might use themselves, and one twice."""
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.selectExpr("*", "1 as row", "'x' as key", "2 as kept", "3 as id", "4 as component_id", "5 as n_words", "6 as KEPT2", "7 as mark")


def doubled(spark):
    """As ``frame`` with a doubled name."""
    df = frame(spark)
    return df.select("*", df["row"].alias("row"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
