"""BPE with word ends by a prefix-sharing trie: encoding and decoding without a shuffle.

A word is a run of symbols: its bytes, the last one marked as a word's end. Of every prefix of a word only the last token
matters: it is the one token that ends there and follows the last token of what is before it as merges would have it. So the
distinct words of some texts are put into a trie, a depth-first walk gives each node its prefix's last token,
and what several words begin with is computed once. A word's ids are read off backwards, token by token.
The tokens that end a prefix are known from its longest end that a token begins with, which one look into a table gives from
that of the prefix before. Whether two tokens may follow each other is found by merging the symbols of both, once for each pair.

Every task works on its own texts, so a frequent word costs no one more than a look into a table, and a lost task is done
again by itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.common import Memo
from palimpsest.llm.tokens import PLAIN

#: Characters of texts whose words are put into one trie; a longer text has a trie of its own.
TRIE = 1_000_000
#: Distinct words whose encodings a task keeps from one trie to the next.
KEPT = 300_000
#: Symbol number of a byte that ends a word, above that of the byte.
_END = 256
#: The vocabulary's mark of a word's end, and its pattern of words for plain characters in lower case (fixed values).
_MARK = "</w>"
_LETTER, _DIGIT = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_QUICK = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t\n\r {_LETTER}{_DIGIT}]+")


def _byte_of() -> dict[str, int]:
    """The bytes that the characters of byte-level vocabularies stand for: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as strings of symbols, with their ids and forms, and which of them may follow each other."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as lines:
            found = json.load(lines)
        self.library = Tokenizer.from_file(file)
        self.byte_of = _byte_of()
        merges = [x if isinstance(x, list) else x.split(" ") for x in found["model"]["merges"]]
        self.ranks = {(self._symbols(a), self._symbols(b)): n for n, (a, b) in reversed(list(enumerate(merges)))}
        reachable = {a + b for a, b in self.ranks} | {chr(n) for n in range(2 * _END)}
        named = {self._symbols(form): form for form in found["model"]["vocab"]}
        self.form = {token: form for token, form in named.items() if token in reachable}
        self.id = {token: found["model"]["vocab"][form] for token, form in self.form.items()}
        self.shown = {token: str(n) for token, n in self.id.items()}
        self.special = {x["content"]: x["id"] for x in found["added_tokens"]}
        self.form_of = {n: form for form, n in found["model"]["vocab"].items()} | {n: form for form, n in self.special.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        heads = {token[:k] for token in self.id for k in range(len(token) + 1)}
        own = {token: token for token in self.id}  # equal strings are one, so that their hashes are computed once
        self.state = Memo(lambda near: self.state[near[1:]], len(heads) + 300_000)
        self.state.update((head, own.get(head, head)) for head in heads)
        self._ending = Memo(lambda state: [own[state[k:]] for k in range(len(state)) if state[k:] in own])
        self._follows = Memo(lambda pair: self.merged(pair[0] + pair[1]) == [x for x in pair if x], 1_000_000)

    def _symbols(self, form: str) -> str:
        ends = form.endswith(_MARK)
        own = [chr(self.byte_of.get(c, 0)) for c in (form[: -len(_MARK)] if ends else form)]
        return "".join(own[:-1]) + chr(ord(own[-1]) + _END) if ends and own else "".join(own)

    def merged(self, symbols: str) -> list[str]:
        """Symbols after all merges, lowest rank first, left before right. For strings of two tokens' length."""
        parts, find, none = list(symbols), self.ranks.get, len(self.ranks)
        pairs = [find(pair, none) for pair in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            at = pairs.index(low)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = find((parts[at - 1], parts[at]), none)
            if at < len(pairs):
                pairs[at] = find((parts[at], parts[at + 1]), none)
        return parts

    def last(self, states: list[str], tokens: list[str]) -> str:
        """The last token of a prefix, from those of all shorter prefixes, of which the first is empty, and the states of both:
        each is a prefix's longest end that a token begins with."""
        end, follows = len(tokens), self._follows
        for token in self._ending[states[-1]]:
            if follows[tokens[end - len(token)], token]:
                return token
        raise ValueError(f"no token ends {states[-1]!r}")

    def words(self, text: str) -> list[str]:
        """The words and special tokens of a text in order, a word as the bytes that the library's rules make of it."""
        if self._special is None or "<|" not in text:
            return self._words(text)
        out = []
        for part in self._special.split(text):
            out += [part] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        lower = text.lower()
        if PLAIN.fullmatch(lower) and PLAIN.fullmatch(text):
            return _QUICK.findall(lower)
        made = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, form)).decode("utf-8", "surrogateescape") for form, _ in made]


@cache
def vocabulary(file: str) -> Vocabulary:
    """One vocabulary for all tasks of a worker process."""
    return Vocabulary(file)


class Trie:
    """Words by their prefixes; they come in ascending order, so a word shares with the one before all it shares with any.

    Nodes lie depth first: a word is its path, and has as nodes of its own those beyond what it shares with the word before.
    """

    def __init__(self):
        self.word: list[str] = []
        self.shared = array("q")

    def insert(self, word: str) -> None:
        newest, shared = self.word[-1] if self.word else "", 0
        for a, b in zip(word, newest):
            if a != b:
                break
            shared += 1
        self.word.append(word)
        self.shared.append(shared)

    def encoded(self, known: Vocabulary) -> Iterator[tuple[str, list[str]]]:
        """(word, tokens) of all words, depth first; ``states`` and ``last`` are those of the prefixes of the path."""
        states, last = [""], [""]
        state, find = known.state, known.last
        for word, shared in zip(self.word, self.shared):
            del states[shared + 1 :], last[shared + 1 :]
            for symbol in word[shared:]:
                states.append(state[states[-1] + symbol])
                last.append(find(states, last))
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield word, out[::-1]


def _symbols(word: str) -> str:
    own = word.encode("utf-8", "surrogateescape")
    return own[:-1].decode("latin-1") + chr(own[-1] + _END)


class _Encoder:
    """Words to (number of ids, ids in decimal, forms of the tokens), both joined by blanks; new words come through a trie."""

    def __init__(self, known: Vocabulary):
        self.known = known
        self.found: dict[str, tuple[int, str, str]] = {}

    def learn(self, words: Iterable[str]) -> None:
        if len(self.found) > KEPT:
            self.found = {}
        trie, new = Trie(), set(words).difference(self.found)
        for word in new.intersection(self.known.special):
            self.found[word] = (1, str(self.known.special[word]), word)
        of = {_symbols(word): word for word in new.difference(self.known.special)}
        for own in sorted(of):
            trie.insert(own)
        for own, tokens in trie.encoded(self.known):
            ids, forms = map(self.known.shown.__getitem__, tokens), map(self.known.form.__getitem__, tokens)
            self.found[of[own]] = (len(tokens), " ".join(ids), " ".join(forms))


@cache
def encoder(file: str) -> _Encoder:
    """One encoder for all tasks of a worker process."""
    return _Encoder(vocabulary(file))


def decode(ids: list[int], known: Vocabulary) -> str:
    """The forms of the tokens joined by blanks, as the library gives them for a vocabulary without a decoder; it passes over
    numbers that no token has."""
    return " ".join([known.form_of[n] for n in ids if n in known.form_of])


def encode(docs: DataFrame, file: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by blanks) and decoded_sha256 of every row of (doc_id, text);
    with ``keep`` ids (array) and the decoded text too.

    A null text is an empty one and has no ids. Rows of equal or null doc_id stay apart; other columns are not read. The
    vocabulary's special tokens count as such wherever they stand in a text, as in the library.
    """
    file = file or path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = encoder(file), vocabulary(file)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                first, chars, split = at, 0, []
                while at < batch.num_rows and (at == first or chars < TRIE):
                    text = texts[at].as_py() or ""
                    split.append(known.words(text))
                    chars += len(text)
                    at += 1
                own.learn(chain.from_iterable(split))
                rows = []
                for words in split:
                    many, shown, forms = zip(*map(own.found.__getitem__, words)) if words else ((), (), ())
                    text = " ".join(shown)
                    numbers = [int(x) for x in text.split()] if keep else []
                    decoded = decode(numbers, known) if keep else " ".join(forms)
                    row = (sum(many), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, numbers, decoded) if keep else row)
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep else 4]
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
