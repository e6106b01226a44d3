"""Small documents with every odd case, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORDS = "the of and to in a is that for it was on are as with his they at be this from".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + (str(draw.randrange(40)) if draw.random() < 0.4 else "") for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text): copies, near copies, nulls, empty, very long, repeated and missing ids."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "CHANGED"
    return [
        (10, base), (11, base), (12, " ".join(near)), (13, None), (14, ""), (15, " \n\t "), (16, "One two"), (17, "one TWO"),
        (18, prose(2, 3000) + "\n" + base), (19, "é ü, naïve — ok\n" * 12), (20, "aaaa " * 400), (21, prose(3, 80) + " " + prose(4, 60)),
        (22, prose(4, 60) + " " + prose(5, 80)), (23, "x"), (24, "under the MIT license; Apache-License, version 2.0 & cc-by-nc " + prose(6, 60)),
    ]


def odd_documents() -> list[tuple]:
    return [*documents(), (10, prose(1, 120)), (23, "y z"), (23, "y z"), (None, "no id here"), (None, None), (-5, "Negative id")]


# Columns whose names the operators also use inside.
EXTRA = ["n", "place", "words", "start", "kept", "component", "score", "slice"]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(1).alias(c) for c in EXTRA])
    return df.repartition(3)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
