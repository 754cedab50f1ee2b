"""Token ids of texts under a word-level BPE, with one call of the tokenizer for all new words of many texts."""

from __future__ import annotations

import os
import re

import numpy as np

from leadlens.llm.common import remembered

#: White space that str.split() and the tokenizer may see differently, the capital whose lower case is two marks, which the
#: tokenizer orders after lowering, and the tokenizer's own markers: such texts go whole.
_ODD_POINTS = [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x130, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF]
_ODD = re.compile("[" + "".join(map(chr, _ODD_POINTS)) + "]|<[|]")
#: Words kept by a worker.
KEPT_WORDS = 1_000_000


class WordBpe:
    """Words between white space are encoded apart: this vocabulary drops white space and no piece crosses it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.mark = next(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark_id = self.tokenizer.token_to_id(self.mark)

    @staticmethod
    def load(path: str) -> WordBpe:
        kept = remembered("packing")
        return kept[path] if path in kept else kept.setdefault(path, WordBpe(path))

    def _new(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw = ids.tobytes()
            out.update((w, raw[4 * a + 4 : 4 * b]) for w, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))
        return out

    def _complete(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words; a mark at the end of a word is a piece of its own, so that the word before it may be known."""
        known = self.known
        split = {w for w in words if len(w) > 1 and w[-1] in ".,;:!?" and w[-2].isalpha()}
        bare = {w[:-1] for w in split} | {w[-1] for w in split} | (words - split)
        out = self._new([w for w in bare if w not in known])
        get = lambda w: known[w] if w in known else out[w]
        out.update([(w, get(w[:-1]) + get(w[-1])) for w in split])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, as the tokenizer gives them without special tokens."""
        # The vocabulary is lower case; only a capital sigma is lowered by its place in the word.
        words = [None if _ODD.search(t) else (t if "\u03a3" in t else t.lower()).split() for t in texts]
        known, out, late = self.known, [], []
        for i, (t, ws) in enumerate(zip(texts, words, strict=True)):
            try:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() if ws is None else b"".join(map(known.__getitem__, ws)))
            except KeyError:
                out.append(b"")
                late.append(i)
        if late:
            new = self._complete(set().union(*(words[i] for i in late)) - known.keys())
            if len(known) < KEPT_WORDS:
                known.update(new)
            for i in late:
                out[i] = b"".join([known[w] if w in known else new[w] for w in words[i]])
        return out
