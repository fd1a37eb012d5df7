import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from palimpsest.llm import bpe, packing, trie
from palimpsest.llm.tokens import encoder, merged, pieces, read_ranks

SCHEMA = "doc_id long, text string, lang string, tokens string, block long"
TEXTS = [
    None, "", " ", "\n\n", "Hello, world! It's 42 o'clock.", "a  b   c\t\td \n e\r\nf", "naïve café Übergröße ÿ ª º ² ¼", "日本語テキスト と English", "emoji 👍🏽 family 👨‍👩‍👧",
    "é combining", "x y z　w", "tabs\tand\x1cseparators\x1f here", "word " * 3000, "x" * 5000, "ab" * 4000, "1234567890 " * 50, "don't WE'RE they'll I'd I'm", "<|endoftext|> <s>",
    "   leading", "trailing   ", "mixed\n \n  \n", "﻿bom", "العربية हिन्दी ไทย",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, x, "en", "clash", 1) for i, x in enumerate(texts)], SCHEMA)


def random_texts(n=200):
    rng = random.Random(2)
    alphabet = "ab eé'sßñ.,!?\n\t 0 9²x  日本ї  \x85\x1cÆ-_#"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def multi():
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_make_up_the_text():
    for text in filter(None, TEXTS + random_texts()):
        assert "".join(pieces(text)) == text


def test_encoding_against_the_library(spark, multi):
    texts = TEXTS + random_texts()
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts), block=400, keep=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = packed_ids(multi.encode_ordinary(text or ""))
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) // 4 and got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest(), repr(text)
        assert got[i]["decoded"] == (text or "") and got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encoding_keeps_rows_apart(spark, multi):
    rows = spark.createDataFrame([(1, "same"), (1, "same"), (None, "other"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in bpe.encode(rows).collect())
    n = [len(multi.encode_ordinary(x)) for x in ("same", "other")]
    assert got == [(-1, 0), (-1, n[1]), (1, n[0]), (1, n[0])]
    assert bpe.encode(rows.limit(0)).count() == 0


def test_packing_tokens_against_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    encode = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in filter(None, TEXTS + random_texts()):
        assert encode(text) == packed_ids(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("length, want", [(0, [0]), (1, [0]), (10, [0]), (11, [0, 1]), (20, [0, 10]), (25, [0, 5, 15])])
def test_cut(length, want):
    assert packing.cut(length, 10) == want


def plain_sum_of_squares(lengths, room):
    """The rule itself: try every way, take the one with the least sum of squares (an open one before a new one)."""
    levels = []

    def cost(levels):
        counts = defaultdict(int)
        for x in levels:
            counts[x] += x < room
        return sum(n * n for n in counts.values())

    for size in lengths:
        best = None
        for level in sorted({x for x in levels if x + size <= room}):
            after = list(levels)
            after[after.index(level)] += size
            if best is None or cost(after) < cost(best):
                best = after
        fresh = [*levels, size]
        if best is None or cost(fresh) < cost(best):
            best = fresh
        levels = best
    return sorted(x for x in levels if x == room)


def first_fit(lengths, room):
    """The number of sequences if each piece, longest first, goes where it first fits."""
    levels = []
    for size in lengths:
        at = next((i for i, x in enumerate(levels) if x + size <= room), None)
        if at is None:
            levels.append(size)
        else:
            levels[at] += size
    return len(levels)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(1, 20) for _ in range(120)), reverse=True)
    found = packing.sum_of_squares(lengths, 20)
    assert sorted(i for x in found for i in x) == list(range(120))
    fill = [sum(lengths[i] for i in x) for x in found]
    assert max(fill) <= 20
    # sequences that the rule fills up stay; the others are placed once more, so there are at least as many full ones
    assert fill.count(20) >= len(plain_sum_of_squares(lengths, 20))
    assert len(found) <= first_fit(lengths, 20) + 1


def check_packing(rows, texts, room):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= room
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own, end = sorted(by_doc[i], key=lambda r: r["piece"]), 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, end)
            assert k == 0 or r["length"] == room
            assert r["ids_crc32"] == zlib.crc32(packed_ids(ids[end : end + r["length"]]))
            end += r["length"]
        assert end == len(ids) and (len(own) == 1 or len(ids) > room)
    return len(at)


def test_packing(spark):
    texts = TEXTS + random_texts()
    rows = packing.pack(frame(spark, texts), room=64).collect()
    n = check_packing(rows, texts, 64)
    assert n <= -(-sum(r["length"] for r in rows) // 64) + 2


def test_packing_in_shards(spark):
    texts = random_texts(300)
    check_packing(packing.pack(frame(spark, texts), room=64, shard=50).collect(), texts, 64)


def test_packing_of_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(1, "same"), (1, "same"), (None, None), (None, "x")], "doc_id long, text string")
    got = packing.pack(rows).collect()
    assert len(got) == 4 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    assert packing.pack(rows.limit(0)).count() == 0


def test_merging_against_the_library(multi):
    """Pieces of all lengths, on both sides of where the heap begins."""
    rng = random.Random(4)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = ["".join(rng.choice("aeiourtnsléü") for _ in range(n)) for n in [*range(1, 130), 99, 100, 101, 500, 3000]] + ["x" * n for n in (1, 50, 99, 100, 1000)] + ["ab" * 400, "日本語" * 60]
    for piece in made:
        assert merged(piece.encode(), ranks) == multi._core_bpe.encode_single_piece(piece.encode()), piece[:50]


def test_a_very_long_piece_takes_no_square_time():
    import time

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    began = time.time()
    assert b"".join({v: k for k, v in ranks.items()}[i] for i in merged(b"xy" * 100, ranks)) == b"xy" * 100
    merged(random.Random(1).randbytes(300_000), ranks)
    assert time.time() - began < 30


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def word_texts():
    every = "".join(map(chr, range(1, 0x600)))
    return TEXTS + random_texts() + [every, " ".join(every), "İstanbul ǅ Σίσυφος ΑΣ", "a<|endoftext|>b <|startoftext|><|EndOfText|>", "can't WON'T 's't're 1234½²", "x" * 3000 + "y", "the theme thence then " * 20]


def test_words_through_a_trie_against_the_library(spark, word_library, monkeypatch):
    monkeypatch.setattr(trie, "TRIE", 2000)
    texts = word_texts()
    got = {r["doc_id"]: r for r in trie.encode(frame(spark, texts), keep=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = word_library.encode(text or "", add_special_tokens=False).ids
        decoded = word_library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids), repr(text)[:80]
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded"] == decoded and got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_words_of_repeated_and_missing_rows(spark, word_library):
    rows = spark.createDataFrame([(1, "same same"), (1, "same same"), (None, "other"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in trie.encode(rows).collect()) == [(-1, 0), (-1, 1), (1, 2), (1, 2)]
    assert trie.encode(rows.limit(0)).count() == 0


def test_trie_shares_prefixes():
    known = trie.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    calls, last = [], known.last
    words = sorted(trie._symbols(x) for x in ("interest", "interests", "interesting", "internal", "in"))
    own = trie.Trie()
    for x in words:
        own.insert(x)
    known.last = lambda path, lengths: calls.append("".join(path)) or last(path, lengths)
    try:
        found = dict(own.encoded(known))
    finally:
        del known.last
    assert sorted(found) == words and all("".join(v) == k for k, v in found.items())
    assert len(calls) == len(set(calls)) == len({x[:n] for x in words for n in range(1, len(x) + 1)})


def test_words_not_seen_again_are_found_again(word_library, monkeypatch):
    monkeypatch.setattr(trie, "KEPT", 3)
    known = trie.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    own = trie._Encoder(known)
    for text in ("one two three four", "five one", "two <|endoftext|> six"):
        own.learn(known.words(text))
        assert " ".join(own.found[x][1] for x in known.words(text)) == " ".join(map(str, word_library.encode(text, add_special_tokens=False).ids))


def test_a_prefix_is_known_by_its_longest_end_that_a_token_begins_with(word_library):
    """Each distinct prefix is looked at once, by an end of no more than a token's length."""
    known = trie.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    made = {"".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 40))) for _ in range(300)} | {"x" * 400, "ab" * 150, "the", "thethe"}
    seen, last = [], known.last
    known.last = lambda states, tokens: seen.append(states[-1]) or last(states, tokens)
    own = trie.Trie()
    for word in sorted(map(trie._symbols, made)):
        own.insert(word)
    found = dict(own.encoded(known))
    heads = {token[:k] for token in known.id for k in range(len(token) + 1)}
    longest = lambda x: next(x[k:] for k in range(len(x) + 1) if x[k:] in heads)
    assert sorted(seen) == sorted(map(longest, {w[:n] for w in found for n in range(1, len(w) + 1)}))
    for word in made:
        assert [known.id[x] for x in found[trie._symbols(word)]] == word_library.encode(word, add_special_tokens=False).ids


def test_merges_of_words_one_by_one(word_library):
    known = trie.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(10)
    for word in ["".join(rng.choice("aeinrstlé") for _ in range(n)) for n in [*range(1, 40), 200]] + ["a" * 50, "e", "abab" * 20]:
        assert [known.id[x] for x in known.merged(trie._symbols(word))] == word_library.encode(word, add_special_tokens=False).ids
    assert known.merged("") == []
