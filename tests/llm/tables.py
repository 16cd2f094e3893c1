"""Small tables with the awkward rows every operator has to take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = SCHEMA + ", rk bigint, part int, tid string, label string, score string, h binary, n int, words string, fp int"

WORDS = "the of and to in river stone letter window market garden simple quiet early evening paper number always".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(30)]
    passage = prose(rng, 40)
    out = list(base)
    out += [base[3], base[3], base[4] + " more", base[5].upper(), "x" + base[5][1:]]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)]
    out += [f"{passage}\n{prose(rng, 10)}", prose(rng, 10) + passage]
    out += ["", " ", "\n\t ", "a", "ab " * 400, "é ü — 日本語 " * 30, "  two  blanks\n next\r\nline ", "The THE the <|endoftext|> #2 \x00 z"]
    out += ["same line\nsame line\nother\nsame line", "€€€%%% ### |||", prose(rng, 9000), "ß" * 5000]
    return [*out, None]


def rows(seed: int = 5) -> list[tuple]:
    """Shuffled rows; ids are not dense, and start below zero."""
    made = [(3 * i - 20, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts(seed))]
    random.Random(1).shuffle(made)
    return made


def documents(spark, seed: int = 5, schema: str = SCHEMA):
    pad = (None,) * (schema.count(",") - SCHEMA.count(","))
    return spark.createDataFrame([r + pad for r in rows(seed)], schema)


def odd_documents(spark):
    """Equal rows, equal ids with different texts, null ids; clashing columns."""
    made = rows(5)[:20] + rows(5)[:3]
    made += [(1, "first text of one id " * 8, "en", "s", 1), (1, "second text of one id " * 8, "en", "s", 1)]
    made += [(None, "text without id " * 9, None, None, None), (None, "text without id " * 9, None, None, None), (None, None, None, None, None)]
    pad = (None,) * (EXTRA.count(",") - SCHEMA.count(","))
    return spark.createDataFrame([r + pad for r in made], EXTRA), made


def empty(spark, schema: str = EXTRA):
    return spark.createDataFrame([], schema)
