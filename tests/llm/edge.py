"""Small tables that hold what the operators have to bear."""

from __future__ import annotations

import random

WORDS = "the of and to in that it is was for on are as with they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.03 else "") for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empties, copies, near copies, shared passages, one long text."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    base = prose(rng, 150)
    texts += [base] * 5
    for _ in range(8):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [prose(rng, 20) + passage + prose(rng, 20) for _ in range(6)]
    texts += [None, "", " \n\t ", "one", "One", "naïve café – “quotes” 日本語 😀\n" * 9, prose(rng, 20_000), "a" * 500, "ab" * 300]
    return [(i * 3, t, "en", [None, "src0", "src0", "src1", "x"][rng.randrange(5)], None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
