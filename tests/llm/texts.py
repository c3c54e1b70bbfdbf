"""Random documents with copies, near copies and shared passages, and hostile rows."""

import random
import re

NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HOSTILE = [None, "", " ", "\n\t", "one", "ONE", "a  b\tc", "é", "É é é", "a" * 3000, "x y " * 2000, " wide", "日本 日本", "😀 a", "a\x00b"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_documents(seed, n=60, vocabulary=30, words=60):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            text = r.choice(texts)
        elif texts and kind < 0.4:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = f"w{r.randrange(vocabulary)}"
            text = " ".join(w)
        elif texts and kind < 0.6:
            w = r.choice(texts).split(" ")
            a = r.randrange(len(w))
            text = " ".join(f"w{r.randrange(vocabulary)}" for _ in range(10)) + " " + " ".join(w[a : a + 40])
        else:
            text = " ".join(f"{r.choice('wWé')}{r.randrange(vocabulary)}" for _ in range(r.randint(1, words)))
        texts.append(text)
    rows = [(i * 3 % (3 * n) + 1, t) for i, t in enumerate(texts + HOSTILE)]
    rows += [(None, texts[0]), (None, None), rows[3], rows[3]]
    r.shuffle(rows)
    return rows
