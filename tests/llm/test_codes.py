import hashlib
import math
import random
from fractions import Fraction

from palimpsest.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, id long, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 7, "clash") for i, v, label in rows], SCHEMA)


def plain(rows, rounds=6):
    """The contract with Python's integers, a vector, a part, an entry at a time."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    split = [[v[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    books = [[split[k][p] for k in range(min(16, len(kept)))] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(8)] for x in split]

    for _ in range(rounds):
        found = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [x[p] for x, at in zip(split, found) if at[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in at) for at in found]
    digest = hashlib.sha256(",".join(str(x) for part in books for c in part for x in c).encode()).hexdigest()
    out = []
    for (i, _, label), at, error in zip(kept, found, errors):
        out.append((i, "".join(f"{e:02x}" for _, e in at), error, sum(e for e, r in zip(errors, kept) if r[2] == label), digest))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def vectors(n, length=16, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 5, 1) for _ in range(length)], rng.choice([None, 1, 2])) for i in rng.sample(range(10 * n), n)]


def check(spark, rows, parts=3):
    got = [tuple(r)[:5] for r in codes.compress(frame(spark, rows).repartition(parts)).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_against_plain_integers(spark):
    check(spark, vectors(120))


def test_unsound_vectors_repeated_rows_and_ids(spark):
    rows = vectors(40) + [(5000, None, 1), (5001, [1.0] * 15 + [None], 1), (5002, [float("nan")] * 16, 1), (5003, [float("inf")] + [0.0] * 15, 2), (None, [0.5] * 16, 1)]
    rows += [rows[3], rows[3], (rows[0][0], [-2.0] * 16, 2)]
    check(spark, rows)


def test_few_rows_ties_and_zeros(spark):
    check(spark, [(i, [0.0] * 8, None) for i in range(3)])
    check(spark, [(i, [float(i % 2)] * 8, i) for i in range(40)])


def test_components_beyond_machine_integers(spark):
    rows = [(i, [x * 10.0 ** (i % 3 * 9) for x in v], label) for i, v, label in vectors(60, 8)]
    got = {r["vec_id"]: r for r in codes.compress(frame(spark, rows)).collect()}
    for i, code, error, _, digest in plain(rows):
        assert (got[i]["code"], got[i]["codebooks_sha256"]) == (code, digest) and got[i]["error"] == (error if error < 1 << 63 else None)


def test_lengths_have_codebooks_of_their_own(spark):
    a, b = vectors(30, 8, 2), [(1000 + i, v, label) for i, v, label in vectors(30, 16, 3)]
    odd = [(2000, [0.1, 0.2, 0.3], 1), (2001, [], 2)]
    got = {r["vec_id"]: tuple(r) for r in codes.compress(frame(spark, a + b + odd)).collect()}
    assert len(got) == 62
    for rows in (a, b):
        assert {(i, got[i][1], got[i][2], got[i][4]) for i, *_ in rows} == {(x[0], x[1], x[2], x[4]) for x in plain(rows)}
    assert got[2000][1:3] == got[2001][1:3] == ("00" * 8, 0)
    whole = codes.CODEBOOKS
    codes.CODEBOOKS = 1  # each length by itself
    try:
        assert {r["vec_id"]: tuple(r) for r in codes.compress(frame(spark, a + b + odd)).collect()} == got
    finally:
        codes.CODEBOOKS = whole


def test_empty_table(spark):
    assert codes.compress(frame(spark, [])).count() == 0
    assert codes.compress(frame(spark, [(1, None, 1)])).count() == 0
