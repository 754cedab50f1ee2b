"""Paths below large nodes, words met late, and snippets cut by arrays agree with plain versions."""

import random

import numpy as np

from leadlens.llm import minhash, suffix
from leadlens.llm.common import prefix_hash, range_hash
from leadlens.llm.queries import vocabulary
from leadlens.llm.wordbpe import WordBpe


def test_paths_hold_every_step():
    sig = np.random.default_rng(1).integers(0, 1 << 32, (3, minhash.FUNCTIONS), dtype=np.uint64).astype(np.uint32)
    row, node, parent = minhash.children(np.array([0, 1, 2]), np.array([5, 5, 9], np.uint64), sig)
    assert len(row) == len(node) == len(parent) and set(zip(row.tolist(), parent.tolist(), strict=True)) == {(0, 5), (1, 5), (2, 9)}
    below = minhash.children(row, node, sig)
    assert set(below[2].tolist()) == set(node.tolist())


def test_words_met_late(monkeypatch):
    monkeypatch.setattr("leadlens.llm.wordbpe.KEPT_WORDS", 3)
    bpe, rng = WordBpe(vocabulary("word_bpe_49k.json")), random.Random(3)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("abcDEé.,") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 9))) for _ in range(20)] + ["", " \n", "odd space"]
        assert bpe.encode(texts) == [np.array(bpe.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]


def test_snippets_cover_every_window():
    rng = random.Random(5)
    docs = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 49, 50, 51, 400, 0, 130, 10)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    r, prefix = suffix.runs(data, offsets), prefix_hash(np.frombuffer(b"".join(docs), np.uint8))
    windows = [(i, offsets[i] + k) for i, d in enumerate(docs) for k in range(len(d) - suffix.LENGTH + 1)]
    got = [(d, w) for d, a, b in zip(r["doc"].tolist(), r["first"].tolist(), r["last"].tolist(), strict=True) for w in range(a, b + 1)]
    assert got == windows
    for a, b, p, h in zip(r["first"].tolist(), r["last"].tolist(), r["anchor"].tolist(), r["h"].tolist(), strict=True):
        assert b <= p <= a + suffix.LENGTH - suffix.GRAM and h == range_hash(prefix, np.array([p]), np.array([p + suffix.GRAM]))[0]
