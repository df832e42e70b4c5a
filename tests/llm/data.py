"""Small awkward tables, and brute-force versions of the operators."""

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "the of and to in stone river market letter window copper garden under seven people idiot worthless licence of".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def texts() -> list[str | None]:
    """Nulls, empty and very long texts, repeats, near copies, shared passages, odd characters."""
    rng = random.Random(7)
    one, passage = prose(rng, 300), prose(rng, 60)
    near = one.split()
    near[150] = "altered"
    out = [None, "", " \n\t ", "one", "one two", "one two three", one, one, " ".join(near), one.upper(), prose(rng, 20_000), "É" * 300 + " ünïcode — text " * 40]
    out += [prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 80) for _ in range(6)]
    out += ["same line\nsame line\n\nother\n" * 30, "a b c " * 100, "Licensed under the Apache License, Version 2.0.\n" + prose(rng, 70), "under the MIT License or the MIT license " + prose(rng, 60)]
    out += ["### $$$ <b>|x|</b> " * 30, "x y z \x1c w " * 20, "don't 12,345.67 '' 's <|endoftext|> _a_ ñandú² " * 5]
    return out


def documents(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """Documents with nulls in every column and extra columns whose names clash with those of operators."""
    rows = list(enumerate(texts())) if rows is None else rows
    data = [(i, t, [None, "en", "fr", "xx"][k % 4], [None, "src0", "src1"][k % 3], None if t is None else len(t), k, "clash", -1.0) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n long, word string, score double")


def raw(t: str | None) -> bytes:
    return (t or "").encode()


def words(t: str | None) -> list[bytes]:
    return raw(t).lower().split()
