"""Documents with nulls, empty, short, very long and repeated texts, and columns whose names the operators use themselves."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string, maybe int, block string, c0 string, tokens string"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(50)
    near = base.split()
    near[60] = "Changed"
    far = near[:30] + prose(90).split()
    rows = [None, "", "   \n\t ", "one", "One", "two words", base, base, base.upper(), " ".join(near), " ".join(far), prose(200) + " " + passage, passage + " " + prose(40), passage, prose(30000), "x" * 50000, "é ü 漢字 Ж " * 12, "\u00a0odd\u2003spaces\u0085", prose(34), prose(35)]
    rows.append(rows[14])
    out: list[tuple[int | None, str | None]] = [(i * 7 % 101, t) for i, t in enumerate(rows)]
    return out + [(None, prose(40)), out[6]]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "xx", "s", len(t or ""), None, "n", 1, "b", "c", "t") for i, t in rows], SCHEMA).repartition(3)
