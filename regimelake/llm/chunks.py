"""Cutting texts into chunks that tokenise alone, so that each distinct chunk is tokenised once."""

from __future__ import annotations

import re

#: Distinct chunks that a worker remembers, and characters of them all and of one; others are worked out anew in each batch.
REMEMBERED, CHARACTERS, ONE = 400_000, 16 << 20, 256

#: White space other than spaces and line feeds; zero marks keys.
_ODD = re.compile("[\0\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def spaced_chunks(text: str, cut) -> list[str]:
    """Keys of the chunks of a text under a pattern that starts a piece at each space before a word.

    A key is a word (its chunk has a space before it), a word after a line end (with that line end), or
    a bare chunk after a zero. Texts with other white space are cut by the pattern itself.
    """
    if not text:
        return []
    keys = text.replace("\n", " \n").split(" ")
    if "" in keys or "\n\n" in text or _ODD.search(text):
        return ["\0" + piece for piece in cut(text)]
    keys[0] = "\0" + keys[0]
    return keys


def chunk_of(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


class Chunks:
    """Values of chunks: `solve` works out a list of new keys; up to `most`, of `characters` in all, are kept in the worker."""

    def __init__(self, solve, most: int = REMEMBERED, characters: int = CHARACTERS):
        self.solve, self.most, self.room = solve, most, characters
        self.known: dict = {}

    def values(self, texts: list[list[str]]) -> list[list]:
        """The value of each key of each text."""
        known = self.known
        new = list({k for keys in texts for k in keys if k not in known})
        if new:
            found = dict(zip(new, self.solve(new), strict=True))
            size = sum(map(len, new))
            fits = len(found) <= self.most - len(known) and size <= self.room and max(map(len, new)) <= ONE
            if not fits:
                kept, size = {}, 0
                for k in new:
                    if len(k) <= ONE and len(kept) < self.most - len(known) and size + len(k) <= self.room:
                        kept[k], size = found[k], size + len(k)
            known.update(found if fits else kept)
            self.room -= size
            if not fits:
                get, more = known.get, found.get
                return [[more(k) if (v := get(k)) is None else v for k in keys] for keys in texts]
        return [list(map(known.__getitem__, keys)) for keys in texts]
