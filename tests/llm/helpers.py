"""Fixtures shared by the tests: awkward rows, and invented prose."""

import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo".split()
EXTRA = "kept boolean, component_id string, score string, rank int, pid string, rid int, leaks int, x array<int>, h bigint, key string"


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(words))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(w if rng.random() > share else "q" + w for w in text.split(" "))


def awkward(n: int = 60, seed: int = 1) -> list[tuple]:
    """``(doc_id, text)``: nulls, blanks, short and very long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(n)]
    passage = prose(rng, 60)
    rows: list[tuple] = [(i, t) for i, t in enumerate(base)]
    rows += [(n + i, base[i]) for i in range(8)] + [(n + 10 + i, base[20]) for i in range(30)]
    rows += [(n + 50 + i, edited(rng, base[30 + i % 4], 0.02)) for i in range(24)]
    rows += [(n + 80 + i, prose(rng, 10) + " " + passage + " " + prose(rng, 10)) for i in range(12)]
    rows += [(n + 100, None), (n + 101, ""), (n + 102, " \t\n"), (n + 103, "one"), (n + 104, "One"), (n + 105, "one two three"), (n + 106, "ÄÖ ß 漢字 🙂 é"), (n + 107, "x" * 20000), (n + 108, "x" * 20001)]
    rows += [(n + 109, prose(rng, 20000)), (n + 110, base[3].replace(" ", "\n")), (n + 111, base[3].upper()), (5, base[5]), (5, base[5]), (None, base[7]), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra: bool = True):
    """A documents table; with ``extra``, columns whose names the operators use themselves, all null."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    k = EXTRA.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * k) for r in rows], f"doc_id bigint, text string, {EXTRA}")
