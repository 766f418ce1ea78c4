"""Small corpora for the text operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A column that clashes with names used inside, and columns with odd names.
SCHEMA = "doc_id long, text string, lang string, source string, kept string, _row int, `a b` int, key string"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Random texts, copies, near copies, shared passages, and the odd cases that every operator must take."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ßu", "té") for b in ("ra", "no", "x", "漢", "st.")]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts: list[str | None] = []
    for _ in range(n):
        body = [r.choice(vocabulary) + str(r.randrange(50)) for _ in range(r.randint(1, 120))]
        kind = r.random()
        if kind < 0.2 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.4 and texts and (base := words(r.choice(texts))):
            base[r.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        elif kind < 0.6:
            at = r.randint(0, len(body))
            texts.append(" ".join(body[:at]) + "\n" + passage + " " + " ".join(body[at:]))
        else:
            texts.append(" ".join(body))
    texts += [None, "", "", " \n\t", "one", "one", "a b c d", "x" * 5000, " ".join(body * 200), "tab\tand\x0bfeed\x0cend\r\n"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s0", None, "s2")[i % 4], "k", 7, i, None) for i, t in enumerate(texts)]
    rows.append((None, "no id has this text", None, None, None, None, None, None))
    rows.append((None, texts[0], None, None, None, None, None, None))
    rows.append(rows[1])  # a repeated row
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
