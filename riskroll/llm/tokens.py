"""Token ids of whole texts by a public tokenizer (the tokenizers library), per Arrow batch inside a task.

Byte-level BPE works on pre-tokens, and a single space or line feed between two non-space characters always starts a
new pre-token.  So a text without other white space is cut there, and each distinct chunk is tokenized once per worker
and then taken from a bounded cache of two generations (a full one becomes the old one, whose chunks move on when they
are met again, so frequent chunks are never tokenized again); any other text is tokenized whole.  The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)`` (tests compare them), at several times its speed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: White space other than space and line feed, and the cut mark itself.
_OTHER_SPACE = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Chunks of one generation of the cache and their characters: both together take about 200 MB.
CACHE_CHUNKS = 600_000
CACHE_CHARACTERS = 10_000_000


def _plain(text: str) -> bool:
    """Only single spaces and line feeds, each between two non-space characters."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n"
                or text[-1:] in " \n" or _OTHER_SPACE.search(text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    _of: dict[str, Encoder] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One encoder (and chunk cache) per Python worker."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.newline = self._whole(["\n"])[0]
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character stands for a byte
        self.marks = {c: self._whole([c])[0] for c in ".,;:!?"}
        self.mark = int(np.frombuffer(self.newline, "<u4")[0])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _recall(self, chunks: set[str]) -> set[str]:
        """Take chunks of the old generation over; those in neither."""
        old = self.old
        found = [c for c in chunks if c in old]
        self.cache.update(zip(found, map(old.__getitem__, found)))
        return chunks.difference(found)

    def _learn(self, chunks: set[str]) -> None:
        """Cache unseen chunks.  A mark after a letter is a pre-token of its own, so such chunks share their stem.

        Chunks are tokenized together: words behind a space one after the other, others with line feeds between them.
        The bytes of the tokens, or the line feed's id, part the result again.
        """
        known, marks = self.cache, self.marks
        ended = [c for c in chunks if c[-1] in marks and c[-2:-1].isalpha()]
        rest = self._recall({c[:-1] for c in ended}.union(chunks.difference(ended)).difference(known))
        spaced = [c for c in rest if c[0] == " " and c[1:].isalpha()]
        for part in (spaced[i:i + 4000] for i in range(0, len(spaced), 4000)):
            ids = self._whole(["".join(part)])[0]
            reach = np.cumsum(self.token_bytes[np.frombuffer(ids, dtype="<u4")])
            goal = np.cumsum(np.fromiter(map(len, map(str.encode, part)), dtype=np.int64, count=len(part)))
            ends = np.searchsorted(reach, goal) + 1
            self._keep(part, ids, np.concatenate([[0], ends[:-1]]), ends, (reach[ends - 1] == goal).all())
        other = [*rest.difference(spaced)]
        for part in (other[i:i + 2000] for i in range(0, len(other), 2000)):
            ids = self._whole(["\n".join(part)])[0]
            cuts = np.flatnonzero(np.frombuffer(ids, dtype="<u4") == self.mark)
            self._keep(part, ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids) // 4]]),
                       len(cuts) == len(part) - 1)
        known.update((c, known[c[:-1]] + marks[c[-1]]) for c in ended)

    def _keep(self, part: list[str], ids: bytes, starts: np.ndarray, ends: np.ndarray, parted: bool) -> None:
        if parted:
            own = map(ids.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist()))
            self.cache.update(zip(part, own))
        else:
            self.cache.update(zip(part, self._whole(part)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes of unsigned 32-bit integers."""
        cut = [t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if _plain(t) else None for t in texts]
        if len(self.cache) > CACHE_CHUNKS or self.held > CACHE_CHARACTERS:
            self.old, self.cache, self.held = self.cache, {}, 0
        known = self.cache
        known.setdefault("\n", self.newline)
        known.setdefault("", b"")
        new = set().union(*(c for c in cut if c is not None)).difference(known)
        self.held += sum(map(len, new))
        new = self._recall(new)
        if new:
            self._learn(new)
        get = known.__getitem__
        for text, chunks in zip(texts, cut):
            yield self._whole([text])[0] if chunks is None else b"".join(map(get, chunks))
