"""Token ids of whole texts by a public byte-level vocabulary, with memos of what recurs.

A text is cut by the vocabulary's pattern. ``merged`` makes a piece's ids from the vocabulary's rank file, for op8. ``Encoder``
looks up pieces that came before and takes the ids of new ones from the library that reads that file, for op9. The pattern has a quick form for texts of plain characters; op9's tests hold both against the
library that reads the vocabulary's own file.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from functools import cache

import public_tokenizers
import regex
import tiktoken

from palimpsest.llm.common import Memo

#: Characters whose classes do not depend on the Unicode version or the pattern library.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
#: Marks that are a piece of their own after a word.
_MARKS = tuple(",.;:!?")
#: White space next to white space, or tabs and returns.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t\n\r "
_QUICK = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# White space as Unicode defines it: pattern libraries differ over the separators U+001C to U+001F.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EXACT = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{_WHITE}").replace(r"(?!\S)", rf"(?![^{_WHITE}])").replace(r"\s+", f"[{_WHITE}]+"))


def pieces(text: str) -> list[str]:
    """The matches of the pattern; together they are the text."""
    return (_QUICK if PLAIN.fullmatch(text) else _EXACT).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Parts from which on the pairs of a piece are kept in a heap.
MANY = 100
_NONE = 1 << 62


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the piece itself if it is a token, else its bytes after all merges, lowest rank first, left before right."""
    own = ranks.get(piece)
    if own is not None:
        return [own]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) >= MANY:
        return [ranks[x] for x in _merged_by_heap(parts, ranks)]
    pairs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < _NONE:
        at = pairs.index(low)
        parts[at] += parts.pop(at + 1)
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], _NONE)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], _NONE)
    return [ranks[x] for x in parts]


def _merged_by_heap(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The same for a long piece: parts are a linked list, a heap holds pairs; pairs that have changed since are passed over."""
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= len(parts) or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], b""
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(parts) and (r := ranks.get(parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left))
    return [x for x in parts if x]


@cache
def known_ranks(path: str) -> dict[bytes, int]:
    """One table for all tasks of a worker process."""
    return read_ranks(path)


class _Chunks(dict):
    """Memo of what lies between two blanks, with the blank before it or, at a text's or line's start, without."""

    def __init__(self, before: str, word: Memo, limit: int = 150_000):
        super().__init__()
        self.before, self.word, self.limit = before, word, limit

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = self.word.function(self.before + chunk)
        elif chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            ids = self.word[self.before + chunk[:-1]] + self.word[chunk[-1]]
        else:
            ids = b"".join(map(self.word.__getitem__, _QUICK.findall(self.before + chunk)))
        if len(self) < self.limit:
            self[chunk] = ids
        return ids


class Encoder:
    """Texts to the bytes of their ids, little-endian unsigned 32-bit.

    In plain text no piece reaches over a single blank or line end between two other characters, so the text falls into
    chunks that are looked up whole. Text with runs of white space is cut by the pattern.
    """

    def __init__(self, ranks: str):
        words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={})

        def encode(piece: str) -> bytes:
            ids = words.encode_ordinary(piece)
            return struct.pack(f"<{len(ids)}I", *ids)

        self.word = Memo(encode, 150_000)
        self.blank, self.bare = _Chunks(" ", self.word), _Chunks("", self.word)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or any(x in text for x in _RUNS):
            return b"".join(map(self.word.__getitem__, pieces(text)))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.bare[first] + b"".join(map(self.blank.__getitem__, rest)))
        return self.word["\n"].join(lines)


@cache
def encoder(ranks: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(ranks)
