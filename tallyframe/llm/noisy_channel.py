"""Restoring disguised words: a noisy channel over a character language model, decoded by Viterbi.

A writer's intended letters reach us through a channel that swaps letters for look-alikes, draws letters
out and puts spaces or marks between them. For each disguised word there is a lattice with what each
stretch of it may have been; the path with the least sum of channel cost and surprise under a trigram
model of the corpus' characters is the restored word. Words of plain letters have one path only and are
not touched.
"""
from __future__ import annotations

import re

import numpy as np

SIZE = 64  #: character classes: 0 for all that is no letter, 1 to 26 for a to z, the rest for other letters
OTHERS = SIZE - 27
#: Look-alikes and the letters they stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Channel costs: a look-alike, a drawn-out letter, a gap closed; a gap kept, a sign or digit meant as such.
SWAP, DRAWN, CLOSED, KEPT_GAP, KEPT_SIGN = 1.0, 0.7, 0.3, 2.0, 4.0
MARKS = ".-_*~'·,"
#: Words that a task remembers, at most.
KEPT = 150_000
EDGE = ".,;:!?\"'()[]{}<>«»…"
_letters = "[^\\W\\d_]"
_swapped = "[" + re.escape("".join(LOOKALIKES)) + "]"
DISGUISED = re.compile(f"{_letters}.*{_swapped}|{_swapped}.*{_letters}|({_letters})\\1\\1|{_letters}[*_~·.-]{_letters}[*_~·.-]{_letters}")
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")
SPLIT_RUNS = re.compile(r"(.)\1*", re.S)


def char_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % OTHERS if c.isalpha() else 0


def class_table() -> np.ndarray:
    """Class of every code point up to U+FFFF; later ones are letters of the last class or none."""
    return np.array([char_class(chr(c)) for c in range(0x10000)], np.int64)


def count_trigrams(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Counts of class trigrams; whatever lies between words is one boundary."""
    points = np.frombuffer((" ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.concatenate([[0], table[np.minimum(points, 0xFFFF)]])
    classes = classes[np.concatenate([[True], (classes[1:] != 0) | (classes[:-1] != 0)])]
    if len(classes) < 3:
        return np.zeros(SIZE ** 3, np.int64)
    return np.bincount((classes[:-2] * SIZE + classes[1:-1]) * SIZE + classes[2:], minlength=SIZE ** 3)


def surprise(counts: np.ndarray, smooth: float = 0.05) -> np.ndarray:
    """-log P(c | a, b), as nested [a][b][c]."""
    cube = counts.reshape(SIZE, SIZE, SIZE).astype(float) + smooth
    return -np.log(cube / cube.sum(axis=2, keepdims=True))


class Channel:
    def __init__(self, counts: np.ndarray):
        self.cost = surprise(counts).tolist()
        self.kept: dict[str, str] = {}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each stretch of equal characters: what it may have been, and what that costs."""
        out = []
        for m in SPLIT_RUNS.finditer(word):
            c, n = m.group(1), len(m.group(0))
            if c == " ":
                out.append([("", CLOSED), (" ", KEPT_GAP)])
                continue
            options = [(c * n, 0.0 if c.isalpha() else KEPT_SIGN)]
            if n > 2 and c.isalpha():
                options += [(c, DRAWN), (c * 2, DRAWN)]
            for x in LOOKALIKES.get(c, ""):
                options += [(x * n, SWAP * n)] + ([(x, SWAP + DRAWN)] if n > 2 else [])
            if c in MARKS and n == 1:
                options.append(("", CLOSED))
            out.append(options)
        return out

    def restore(self, word: str) -> str:
        """The cheapest path through the word's lattice."""
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(word) + [[(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in best.items():
                for shown, price in options:
                    x, y, total = a, b, cost + price
                    for c in shown:
                        k = char_class(c)
                        total += self.cost[x][y][k] if k or y else 0.5
                        x, y = y, k
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, text + shown)
            best = after
        return min(best.values())[1].strip()

    def words(self, text: str) -> set[str]:
        """Lower-case words of a text without marks at their edges; a disguised one and what it hides."""
        text = text.lower()
        out = set()
        for word in set(text.split()):
            plain = self.kept.get(word)
            if plain is None:
                plain = word.strip(EDGE)
                if not plain.isalpha() or DISGUISED.search(plain):
                    bare = word.strip(EDGE.replace("!", "").replace("(", ""))
                    plain = f"{plain} {self.restore(bare).strip(EDGE)}" if DISGUISED.search(bare) else plain
                if len(word) <= 40 and len(self.kept) < KEPT:
                    self.kept[word] = plain
            out.update(plain.split(" "))
        for run in SPACED.finditer(text):
            out.update(self.restore(" ".join(run.group(0).split())).split())
        out.discard("")
        return out
