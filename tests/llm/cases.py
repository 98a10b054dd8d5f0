"""Small tables with the cases every corpus operator must take: nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WHITE = " \t\n\x0b\x0c\r"


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]


def prose(rng: random.Random, n: int) -> str:
    stems = ["thal", "mor", "een", "ü", "qa", "son", "bri", "日本", "vo", "lek"]
    out = []
    for _ in range(n):
        w = "".join(rng.choice(stems) for _ in range(rng.randint(1, 3)))
        out.append(w.capitalize() if rng.random() < 0.2 else w)
        out.append(rng.choice([" ", " ", " ", " ", ", ", ".\n", "\t", "  "]))
    return "".join(out)


def documents() -> list[tuple]:
    rng = random.Random(5)
    line = "This very line is shared by a good many documents of all kinds"
    rows = [(i, prose(rng, rng.randint(1, 90)), "en", f"s{i % 3}", 10) for i in range(30)]
    rows += [(30 + i, rows[4][1], "en", "s0", 10) for i in range(12)]                      # copies
    rows += [(45 + i, rows[9][1] + f" tail{i}", "de", None, None) for i in range(8)]        # near copies
    rows += [(55 + i, f"{prose(rng, 5)}\n  {line.upper() if i % 2 else line}\r\nend {i}", "fr", "hot", 1) for i in range(7)]
    rows += [(70, None, None, None, None), (71, "", "en", "s1", 0), (72, " \n\t ", "en", "s1", 3), (73, "one", "en", "s2", 3),
             (74, "two words", "en", "s2", 9), (75, rows[4][1].replace(" ", "  "), "en", "s2", 9),
             (76, prose(rng, 20000), "en", "s1", 5), (77, "x" * 50000, "en", "s1", 5), (78, "\x00 ퟿𝔘 ▁▁ ", "en", "s1", 5)]
    rows += [rows[3], rows[3], (None, "no id at all", "en", "s0", 1), (None, None, None, None, None), (5, "same id, other text", "en", "s1", 1)]
    return rows


def frame(spark, rows=None):
    """The documents with extra columns whose names operators also use."""
    df = spark.createDataFrame(documents() if rows is None else rows, DOCS)
    return df.selectExpr("*", "doc_id AS id", "text AS _text", "1 AS row", "2 AS size", "'k' AS src", "3 AS fp", "4 AS kept",
                         "5 AS score", "6 AS copies", "7 AS component_id", "8 AS target", "9 AS word", "10 AS held_out")
