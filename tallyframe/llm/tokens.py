"""Token ids of whole texts by a public tokenizer, with the words of a worker kept.

The vocabulary used here cuts at white space before anything else, so the ids of a text are the ids of
its words between ASCII white space, one after the other. A word is encoded once while it is kept; at
most ``kept`` words are. Upper case and one closing stop or comma are no words of their own: this
vocabulary lowers case, and a stop after a letter is a piece of its own. A text that holds the literal of one of the
vocabulary's special tokens is encoded whole, by the tokenizer as loaded, which gives that token's id.
"""
from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd

from .hashing import words_in

VOCABULARY = "word_bpe_49k.json"
KEPT = 1_600_000
LONG = 48
AT_ONCE = 200
CHUNK = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordIds:
    """Little-endian unsigned 32-bit ids of texts, through a table of words."""

    def __init__(self, path: str, kept: int = KEPT):
        self.kept = kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        literals = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.special = re.compile("|".join(map(re.escape, literals)).encode() or b"(?!)", re.I)
        self.known: dict[bytes, bytes] = {}
        (self.bar,) = self._plain(["|"])[0]
        self.tails = {t: np.array(i, "<u4").tobytes() for t, i in zip((b".", b","), self._plain([".", ","]))}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Many words in one text, with a bar between them; a word that has a bar goes alone."""
        joined = [w for w in words if b"|" not in w]
        alone = [w for w in words if b"|" in w]
        out = {w: np.array(i, "<u4").tobytes() for w, i in zip(alone, self._plain([w.decode() for w in alone]))}
        groups = [joined[i:i + AT_ONCE] for i in range(0, len(joined), AT_ONCE)]
        for group, ids in zip(groups, self._plain([b" | ".join(g).decode() for g in groups])):
            ids = np.array(ids, "<u4")
            ends = 4 * np.append(np.flatnonzero(ids == self.bar), len(ids))
            raw, at = ids.tobytes(), 0
            for word, end in zip(group, ends.tolist()):
                out[word] = raw[at:end]
                at = end + 4
        return out

    def of(self, blobs: list[bytes]) -> list[bytes]:
        """The ids of each text. Equal words of the texts are looked up once, by a 64-bit hash."""
        if not blobs:
            return []
        raw = b" ".join(blobs) + b" "
        starts, ends, hashes = words_in(np.frombuffer(raw, np.uint8))
        code, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        ids = list(map(self.known.get, words))
        made = self._fresh({w for w, i in zip(words, ids) if i is None})
        ids = [made[w] if i is None else i for w, i in zip(words, ids)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), "<u4")
        n = sizes[code]
        before = np.cumsum(n) - n
        place = np.repeat((np.cumsum(sizes) - sizes)[code] - before, n)
        tokens = table[place + np.arange(len(place))].tobytes()
        edges = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in blobs]))
        cut = 4 * np.append(before, len(place))[edges]
        out = [tokens[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        if self.special.search(raw):
            whole = [i for i, b in enumerate(blobs) if self.special.search(b)]
            for i, of in zip(whole, self._plain([blobs[i].decode() for i in whole])):
                out[i] = np.array(of, "<u4").tobytes()
        return out

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not kept yet; they are kept while there is room."""
        parts = {}
        for w in words:
            core, tail = (w[:-1], w[-1:]) if w[-1:] in self.tails and w[-2:-1].isalpha() else (w, b"")
            parts[w] = (core.lower() if core.isascii() else core, tail)
        cores = {c for c, _ in parts.values()}
        ids = {c: self.known[c] for c in cores if c in self.known}
        ids |= self._encode([c for c in cores if c not in ids])
        out = {w: ids[c] + self.tails[t] if t else ids[c] for w, (c, t) in parts.items()}
        if len(self.known) < self.kept:
            for made in (ids, out):
                self.known.update((w, i) for w, i in made.items() if len(w) <= LONG)
        return out


@lru_cache(maxsize=2)
def word_ids(path: str, kept: int = KEPT) -> WordIds:
    """The worker's own table of up to ``kept`` words (about 200 bytes each); it lives on from task to task."""
    return WordIds(path, kept)


def forget_words() -> None:
    """Lets go of this worker's tables, where memory matters more than the time to fill them anew."""
    word_ids.cache_clear()
