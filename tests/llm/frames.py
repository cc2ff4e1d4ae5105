"""Small frames with everything a table may hold: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import random

LONG = 40_000  # words of a very long text

CLASH = "n_words string, rank int, key string, score string, row_key string, band int, w string, lo int, part int, ranges int, host string, n int, v string, anchor string, kept string, labels string"


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(1 + r.randrange(vocabulary) % 7)) for _ in range(n)]


def texts() -> list[tuple]:
    """(doc_id, text): passages that documents share, copies, near copies and odd texts."""
    shared = prose(1, 80)
    rows = [(i, " ".join(prose(100 + i, 120))) for i in range(20, 30)]
    rows += [(30 + i, " ".join(prose(200 + i, 20) + shared[i : 60 + i] + prose(300 + i, 15))) for i in range(6)]
    body = prose(7, 200)
    rows += [(40, " ".join(body)), (41, " ".join(body)), (39, "\n".join(body))]
    for i in range(6):
        other = list(body)
        other[10 + 30 * i] = "zz"
        rows.append((50 + i, " ".join(other)))
    rows += [(60, None), (61, ""), (62, " \t\n "), (63, "one"), (64, "one two three"), (65, "one two three"), (66, "a " * 300)]
    rows += [(67, " ".join(prose(9, LONG))), (68, "x" * 100_000), (None, " ".join(shared)), (None, None)]
    rows += [(70, " ".join(prose(11, 60))), (70, " ".join(prose(11, 60))), (71, " ".join(prose(12, 60))), (71, " ".join(prose(13, 90)))]
    rows += [(80, "Ünï çødé x  y\r\nz\x0bq\x0cw \x1c v\u0085t 日本 👍 é İΣ  <|endoftext|> ''s'll it's 9.9.\n\n")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [
        (i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *("x", 1, "k", "s", "r", 3, "w", 2, 9, 5, "h", 4, "v", "a", "no", "l"))
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
