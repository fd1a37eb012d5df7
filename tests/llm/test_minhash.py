import random

import numpy as np
import pytest

from palimpsest.llm import minhash
from palimpsest.llm.common import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, text, "en", "web", len(text or "")) for i, text in rows], SCHEMA)


def sets_of(rows, k):
    """Sets of shingles as tuples of words, straight from the definition."""
    out = []
    for doc, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            lower = lower.replace(c, " ")
        words = [w for w in lower.split(" ") if w]
        n = min(k, len(words))
        out.append((doc, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()))
    return out


def brute(rows, k=4, percent=80):
    """All pairs, then the smallest id that each row reaches."""
    found = sets_of(rows, k)
    root = {doc: doc for doc, _ in found if doc is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, left) in enumerate(found):
        for b, right in found[:i]:
            if a is not None and b is not None and left and right and 100 * len(left & right) >= percent * len(left | right):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(((doc, len(own), top(doc) if doc is not None else None, doc is None or top(doc) == doc) for doc, own in found), key=repr)


def result(spark, rows, **options):
    out = minhash.near_duplicates(frame(spark, rows), **options)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=repr)


def near_copy(rng, text, share):
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = f"x{rng.randrange(1000)}"
    return " ".join(words)


def corpus(seed=1, groups=12):
    """Groups of copies whose similarity lies on both sides of the threshold, chains of drifting copies, and strangers."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 200)))
        texts += [base, base.upper(), near_copy(rng, base, 0.01), near_copy(rng, base, 0.03), near_copy(rng, base, 0.06)]
        drift = base
        for _ in range(4):
            drift = near_copy(rng, drift, 0.02)
            texts.append(drift)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def test_against_brute_force(spark):
    rows = corpus()
    assert result(spark, rows, shingle_words=4, percent=80) == brute(rows)


def test_edges(spark):
    rows = [
        (9, "one two three"), (4, "ONE two\tthree"), (5, "one two"), (3, None), (2, ""), (1, " \n\t "), (7, "é É é É e"), (8, "É é é É e"),
        (10, "a b c d e"), (11, "long " * 5000), (12, "long " * 7000), (13, "a b c d"), (14, "a b c d"),
    ]
    assert result(spark, rows, shingle_words=4, percent=80) == brute(rows)
    assert result(spark, []) == []


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    assert sorted(result(spark, rows), key=repr) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=repr)


def test_one_large_group_of_near_copies(spark):
    """A bucket that all near copies share, in which some pairs are linked only through others."""
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(300)}" for _ in range(80))
    rows = [(i, near_copy(rng, base, 0.02)) for i in range(150)]
    assert result(spark, rows, shingle_words=4, percent=80) == brute(rows)


@pytest.mark.parametrize("weight", [4_000_000, 300])
def test_several_blocks(spark, monkeypatch, weight):
    monkeypatch.setattr(minhash, "WEIGHT", weight)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(300)}" for _ in range(60))
    rows = [(i, near_copy(rng, base, 0.04)) for i in range(60)]
    assert result(spark, rows, shingle_words=4, percent=80) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 40, 3000])
def test_signature_walks_a_permutation(n):
    items = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    got = minhash.superminhash(items, 16)
    want = [(1 << 64) - 1] * 16
    for item in items.tolist():  # the walk of one element, in plain steps
        order = list(range(16))
        for j in range(16):
            z = int(minhash.mix(np.array([(item + (j + 1) * int(minhash.GOLDEN)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
            k = j + ((z & 0xFFFFFFFF) * (16 - j) >> 32)
            order[j], order[k] = order[k], order[j]
            want[order[j]] = min(want[order[j]], (j << 32) + (z >> 32))
    assert got.tolist() == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        items = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = minhash.superminhash(items[:900], 96), minhash.superminhash(items[100:], 96)
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_shingles_of_a_repeated_word():
    memo = word_hashes()
    assert len(minhash.shingles("a a a a a a", 4, memo)) == 1 and len(minhash.shingles("a", 4, memo)) == 1
    assert minhash.common(np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)) == 2


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 103), (100, 103)], "a long, b long")
    got = dict(map(tuple, minhash.connected(edges).collect()))
    assert got == {i: 1 for i in range(2, 61)} | {101: 100, 103: 100}


def test_one_id_with_several_texts(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(500)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (5, c), (9, c), (9, d), (10, d + " tail"), (10, d + " tail"), (11, "x y z u v w")]
    want = brute(rows)
    assert result(spark, rows, shingle_words=4, percent=80) == want
    assert {x[0]: x[2] for x in want if x[0] not in (1,)} == {2: 1, 3: 1, 5: 5, 9: 5, 10: 5, 11: 11}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(seed)
    rows = [(rng.randrange(40) if rng.random() < 0.5 else 100 + i, text) for i, (_, text) in enumerate(corpus(seed, 10))]
    rows += rng.choices(rows, k=20)
    assert result(spark, rows, shingle_words=4, percent=80) == brute(rows)


def test_rows_of_an_id_without_words(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (1, ""), (1, base), (1, " \t"), (2, base + " tail"), (2, None), (3, ""), (3, None)]
    got = result(spark, rows, shingle_words=4, percent=80)
    assert [x for x in got if x[1]] == [x for x in brute(rows) if x[1]] and {x[2] for x in got if x[0] == 2 and x[1]} == {1}
    assert [(x[0], x[2], x[3]) for x in got if not x[1]] == [(1, 1, True)] * 3 + [(2, 2, True)] + [(3, 3, True)] * 2


def test_a_text_in_very_many_rows_of_one_id(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base)] * 3000 + [(8, base + " tail")] * 3000 + [(9, "other words stand here now")]
    got = result(spark, rows, shingle_words=4, percent=80)
    assert len(got) == 6001 and {(x[0], x[2]) for x in got} == {(7, 7), (8, 7), (9, 9)}


def test_scratch_tables_can_be_cleared(spark):
    from palimpsest.llm.common import clear_scratch, materialise

    kept = materialise(spark.range(5).toDF("x"))
    assert kept.count() == 5 and clear_scratch(spark) and not clear_scratch(spark)
    assert materialise(spark.range(3).toDF("x")).count() == 3
