"""Small documents with what real tables hold: nulls, empty, blank and long texts, copies, repeated rows, clashing columns."""

import random

#: Columns beside doc_id and text whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, node long, label string, part long, block long, bucket long, key string, h long, shard int"


def words(rng, n):
    return " ".join(rng.choice(["red", "Green", "blue", "pump", "valve", "pipe", "steel", "the", "of", "and"]) + str(rng.randint(0, 40)) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(3, 80)) for _ in range(n // 2)]
    texts = list(base)
    for t in base[: n // 4]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    passage = "a passage that several of the documents share, word for word, over fifty bytes"
    texts += [None, "", "  \n\t ", "one", "One", "two words", "x" * 300, passage, "before " + passage, passage + " after é ☃ 日本語", words(rng, 6000)]
    return [(i, t, "en", "s", len(t or ""), 0, 0, 0, "l", 0, 0, 0, "k", 0, 0) for i, t in enumerate(texts)]


def frame(spark, data):
    return spark.createDataFrame(data, DOCS)
