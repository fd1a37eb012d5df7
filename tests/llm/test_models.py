import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import langid, lm, quality, queries, svm

SMALL = "/root/testdata/sf0.01"


def fold(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def sentence(rng, words, n=30):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {
    "en": "the and of to with house there which would people water because".split(),
    "de": "der und die nicht mit haus werden welche würde leute wasser weil".split(),
    "fr": "le et les de avec maison serait quelle voudrait gens parce que".split(),
    "es": "el los una con casa donde cual querría gente agua porque pero".split(),
}


def test_dual_coordinate_descent_finds_the_optimum():
    """The primal objective at the solution equals the dual one, as it does only at the optimum."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(4), v) for v in x]
    w = svm.fit(rows, y, 4, np.ones(60), epochs=2000)
    primal = 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).sum()
    for _ in range(200):
        v = w + rng.normal(size=5) * 0.05
        assert primal <= 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum() + 1e-6


def language_rows(n=240):
    rng = random.Random(4)
    return [(i, sentence(rng, WORDS[lang]), lang, "web", 1.0) for i, lang in zip(range(n), list(WORDS) * n)]


LANGUAGE = "doc_id long, text string, lang string, source string, score double"


def test_language_of_held_out_rows(spark):
    rows = language_rows()
    got = {r["doc_id"]: r for r in langid.language_of(spark.createDataFrame(rows, LANGUAGE)).collect()}
    assert all(got[i]["held_out"] == (fold(i, 4) == 2) for i, *_ in rows)
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang, *_ in rows if fold(i, 4) == 2)


def test_held_out_labels_are_never_used(spark):
    rows = language_rows()
    other = [(i, text, "xx" if fold(i, 4) == 2 else lang, source, s) for i, text, lang, source, s in rows]
    a, b = (sorted(map(tuple, langid.language_of(spark.createDataFrame(x, LANGUAGE)).collect())) for x in (rows, other))
    assert a == b


def test_language_edges(spark):
    rows = language_rows() + [(1000, None, "en", None, None), (1001, "", "en", None, None), (1002, "12 34 !", None, None, None), (None, "der und die nicht", None, None, None), (1003, "wasser " * 100_000, None, None, None), (1003, "x", None, None, None)]
    got = [r for r in langid.language_of(spark.createDataFrame(rows, LANGUAGE)).collect() if r["doc_id"] is None or r["doc_id"] >= 1000]
    assert len(got) == 6
    by = {(r["doc_id"], r["lang_pred"]): r for r in got}
    assert all((k, "und") in by for k in (1000, 1001, 1002)) and by[(None, "de")]["held_out"] is False and (1003, "de") in by
    assert langid.language_of(spark.createDataFrame([], LANGUAGE)).count() == 0
    only = langid.language_of(spark.createDataFrame([(i, "x y", None, None, None) for i in range(5)], LANGUAGE)).collect()
    assert {r["lang_pred"] for r in only} == {"und"}


def test_families_come_first():
    rng = random.Random(1)
    langs = list(WORDS) * 30
    model = langid.Model([langid.frequencies(sentence(rng, WORDS[x])) for x in langs], langs)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    assert all(model.predict(sentence(rng, WORDS[x]))[0] == x for x in WORDS)


QUALITY = "doc_id long, text string, lang string, quality int, label int"


def quality_rows(n=200):
    rng = random.Random(9)
    good = "The river runs past old houses, and people walk along it.".split()
    bad = "BUY!!! cheap $$$ click >>> now now now win win".split()
    return [(i, sentence(rng, good if i % 2 else bad), "en", 0, 0) for i in range(n)]


def labels_of(spark, rows):
    return spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")


def test_quality_of_held_out_rows(spark):
    rows = quality_rows()
    got = {r["doc_id"]: r for r in quality.quality_of(spark.createDataFrame(rows, QUALITY), labels_of(spark, rows)).collect()}
    for i, *_ in rows:
        assert got[i]["held_out"] == (fold(i, 5) == 0) and got[i]["predicted"] == i % 2 == int(got[i]["score"] >= 0.3)


def test_quality_never_learns_held_out_labels(spark):
    rows = quality_rows()
    docs = spark.createDataFrame(rows, QUALITY)
    other = spark.createDataFrame([(i, 1 - i % 2 if fold(i, 5) == 0 else i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, quality.quality_of(docs, x).collect())) for x in (labels_of(spark, rows), other))
    assert a == b


def test_quality_edges(spark):
    rows = quality_rows() + [(1000, None, None, None, None), (1001, "", None, None, None), (None, "x", None, None, None), (1002, "now " * 100_000, None, None, None)]
    labels = labels_of(spark, rows[:200]).union(spark.createDataFrame([(None, 1, 0), (1000, None, 0), (1001, 7, 0)], "doc_id long, quality int, toxic int"))
    got = quality.quality_of(spark.createDataFrame(rows, QUALITY), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1000] == score[1001] and next(r["held_out"] for r in got if r["doc_id"] is None) is False
    none = quality.quality_of(spark.createDataFrame(rows[:3], QUALITY), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 3
    assert quality.quality_of(spark.createDataFrame([], QUALITY), labels).count() == 0
    one = quality.quality_of(spark.createDataFrame(rows, QUALITY), labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)


@pytest.mark.skipif(not __import__("os").path.isdir(SMALL), reason="no tables")
def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lang = queries.op10_language(spark, SMALL).join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in lang) >= 0.9 * len(lang) > 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = queries.op7_quality(spark, SMALL).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").select("score", "quality").collect()
    good, bad = ([r["score"] for r in found if r["quality"] == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) >= 0.85


def test_gradient_of_the_window_network():
    """One Adagrad step moves each parameter against the sign of its numerical gradient."""
    rng = np.random.default_rng(2)
    network = lm.Network.fresh(rng.integers(1, 50, lm.VOCABULARY).astype(float))
    context, target = rng.integers(0, lm.VOCABULARY, (5, 2 * lm.SIDE)), rng.integers(0, lm.VOCABULARY, 5)
    value = network.parameters[1]
    wanted = []
    for at in [(0, 0), (3, 7), (15, 31)]:
        was = value[at]
        side = []
        for d in (1e-2, -1e-2):
            value[at] = was + d
            side.append(-network.forward(context, target)[3].mean())
        value[at] = was
        wanted.append((at, (side[0] - side[1]) / 2e-2))
    before = value.copy()
    network.step(context, target, [np.zeros_like(x) for x in network.parameters])
    assert all(np.sign(before[at] - value[at]) == np.sign(g) for at, g in wanted if abs(g) > 1e-3)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    network = lm.Network.fresh(rng.integers(1, 50, lm.VOCABULARY).astype(float))
    context = np.repeat(rng.integers(0, lm.VOCABULARY, (1, 2 * lm.SIDE)), lm.VOCABULARY, axis=0)
    assert abs(np.exp(network.forward(context, np.arange(lm.VOCABULARY))[3]).sum() - 1) < 1e-3


def lm_rows(n=300):
    rng = random.Random(8)
    return [(i, " ".join("one two three four five six seven eight".split() * rng.randrange(1, 6))) for i in range(n)]


def test_pseudo_likelihood_knows_the_order(spark):
    rows = lm_rows() + [(900, "one two three four five six seven eight"), (901, "eight three one six two seven four five"), (902, "zq xv wk"), (903, None), (904, ""), (None, "one two")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, lang string, n_tokens long")
    numbers, network = lm.train(docs.select("text"), stride=1, rounds=20)  # so few tokens need more than one pass over an eighth of them
    got = {r["doc_id"]: r for r in lm.score(docs, numbers, network).collect()}
    assert len(got) == len(rows) == lm.pseudo_likelihood(docs).count()
    assert got[900]["mean_log_likelihood"] > got[901]["mean_log_likelihood"] and got[900]["mean_log_likelihood"] > got[902]["mean_log_likelihood"]
    assert all(got[k]["n_tokens"] == 0 and got[k]["log_likelihood"] == 0 and got[k]["mean_log_likelihood"] is None for k in (903, 904))
    assert got[900]["n_tokens"] == 8 and got[None]["n_tokens"] == 2
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_pseudo_likelihood_is_the_sum_over_both_sides(spark):
    docs = spark.createDataFrame(lm_rows(50), "doc_id long, text string")
    numbers, network = lm.train(docs)
    text = "two three nine four"
    tokens = [lm._PAD] * lm.SIDE + [numbers.get(w.encode(), lm._OTHER) for w in text.split()] + [lm._PAD] * lm.SIDE
    total = 0.0
    for i in range(lm.SIDE, len(tokens) - lm.SIDE):
        around = tokens[i - lm.SIDE : i] + tokens[i + 1 : i + 1 + lm.SIDE]
        total += float(network.forward(np.array([around]), np.array([tokens[i]]))[3][0])
    got = lm.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), numbers, network).first()
    assert got["log_likelihood"] == pytest.approx(total, rel=1e-4)


def test_registered_parameters_know_the_order(spark):
    rows = lm_rows() + [(900, "one two three four five six seven eight"), (901, "eight three one six two seven four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.pseudo_likelihood(docs).collect()}
    assert got[900] > got[901] + 1
    numbers, network = lm.train(docs.select("text"))
    assert lm.mean_loss(docs.select("text"), numbers, network) < 1.0  # log(8) = 2.08 without the order


def test_junk_scores_below_prose_when_the_tail_is_long(spark):
    rng = random.Random(5)
    common, tail = [f"c{k}" for k in range(1500)], [f"t{k}" for k in range(4000)]
    weights = [1 / (k + 10) for k in range(1500)]
    prose = [" ".join(rng.choices(common, weights, k=30) + rng.choices(tail, k=30)) for _ in range(600)]
    rows = [*enumerate(prose), (900, "zq xv wk"), (901, " ".join(f"j{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.pseudo_likelihood(docs).collect()}
    low = min(got[i] for i in range(600))
    assert len(got) == len(rows) and got[901] < low and got[900] < low


def plain_chances(parameters, around):
    """Log-probabilities of all tokens between these neighbours, in double precision."""
    vectors, outer, inner, outer_bias, inner_bias = (x.astype(float) for x in parameters)
    hidden = np.tanh(sum(vectors[k][x] for k, x in enumerate(around)))
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    groups = log_softmax(hidden @ outer + outer_bias)
    return np.concatenate([groups[g] + log_softmax(hidden @ inner + inner_bias[g]) for g in range(lm.CLASSES)])


def test_one_training_step_against_a_plain_version():
    """Every parameter that a target or its neighbours touch, and some that none does, by numerical gradients."""
    rng = np.random.default_rng(4)
    network = lm.Network.fresh(rng.integers(1, 50, lm.VOCABULARY).astype(float))
    context, target = rng.integers(0, lm.VOCABULARY, (6, 2 * lm.SIDE)), rng.integers(0, lm.VOCABULARY, 6)
    context[3] = context[2]  # repeated neighbours gather their gradients
    before = [x.copy() for x in network.parameters]
    losses = network.step(context, target, [np.zeros_like(x) for x in network.parameters])
    mean = lambda p: -np.mean([plain_chances(p, a)[t] for a, t in zip(context, target)])
    assert losses.mean() == pytest.approx(mean(before), rel=1e-5)
    places = [(0, (k, context[i, k], w)) for k in range(2 * lm.SIDE) for i in (0, 2) for w in (0, 7)] + [(0, (0, lm.VOCABULARY, 3))]
    places += [(1, (2, target[0] // lm.CLASSES)), (1, (5, 60)), (2, (3, target[1] % lm.CLASSES)), (2, (9, 1)), (3, (target[2] // lm.CLASSES,)), (3, (0,)), (4, (target[3] // lm.CLASSES, target[3] % lm.CLASSES)), (4, (target[4] // lm.CLASSES, 0))]
    for k, at in places:
        side = []
        for d in (1e-4, -1e-4):
            moved = [x.astype(float) for x in before]
            moved[k][at] += d
            side.append(mean(moved))
        gradient = (side[0] - side[1]) / 2e-4
        move = lm.RATE * gradient / np.sqrt(gradient**2 + 1e-8)
        assert before[k][at] - network.parameters[k][at] == pytest.approx(move, abs=2e-3), (k, at)


def test_scores_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 200)
    rng = random.Random(6)
    common, tail = [f"c{k}" for k in range(4200)], [f"t{k}" for k in range(50)]
    rows = [(i, " ".join(common[i * 70 : i * 70 + 70] * 2 + rng.choices(tail, k=5))) for i in range(60)] + [(None, "t1 c1\tT2\nnew"), (70, ""), (71, None), (71, "t1")]
    docs = spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], "doc_id long, text string, n long, word string")
    counts = lm.word_counts(docs)
    numbers, network = lm.train(docs, rounds=1, counts=counts)
    held = {}
    for _, text in rows:
        for w in (text or "").lower().split():
            held[w] = held.get(w, 0) + 1
    assert len(numbers) == lm.VOCABULARY - 1 and {bytes(r["word"]).decode(): r["n"] for r in counts.collect()} == held
    rare = sum(n for w, n in held.items() if w.encode() not in numbers)
    want = []
    for doc, text in rows[:60:6] + rows[60:]:  # each of the others takes a second
        own = (text or "").lower().split()
        tokens = [lm._PAD] * 2 + [numbers.get(w.encode(), lm._OTHER) for w in own] + [lm._PAD] * 2
        total = 0.0
        for i, w in enumerate(own, 2):
            total += plain_chances(network.parameters, [tokens[i - 2], tokens[i - 1], tokens[i + 1], tokens[i + 2]])[tokens[i]]
            total += np.log(held[w] / (rare + 1)) if tokens[i] == lm._OTHER else 0.0
        want.append((str(doc), len(own), total))
    found = lm.score(docs, numbers, network, counts).collect()
    assert len(found) == len(rows)
    want.sort()
    got = sorted(x for r in found if (x := (str(r["doc_id"]), r["n_tokens"], r["log_likelihood"]))[:2] in {y[:2] for y in want})
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-4)


def test_words_are_split_the_same_in_slices(monkeypatch):
    text = " a bb\tccc\néÉ  " * 50 + "x" * 100
    whole = [w for part in lm.words(text) for w in part]
    monkeypatch.setattr(lm, "PIECE", 7)
    assert [w for part in lm.words(text) for w in part] == whole == text.encode().lower().split()


def test_settled_needs_confidence():
    assert not lm.settled([0, 0, 0, 10, 1, 1]) and not lm.settled([100, 500.0, 3000.0, 100, 499.0, 3000.0])
    assert lm.settled([1e6, 5e6, 3e7, 1e6, 4.99e6, 3e7]) and not lm.settled([1e6, 5e6, 3e7, 1e6, 4.9e6, 3e7])


def test_far_logits_are_shifted():
    """Logits that single precision could not take the exponentials of, and near ones with and without a shift."""
    rng = np.random.default_rng(7)
    network = lm.Network.fresh(rng.integers(1, 50, lm.VOCABULARY).astype(float))
    context, target = rng.integers(0, lm.VOCABULARY, (40, 2 * lm.SIDE)), rng.integers(0, lm.VOCABULARY, 40)
    both, near = network.weights()
    assert near and np.allclose(network.forward(context, target)[3], network.forward(context, target, (both, False))[3], atol=1e-4)
    network.parameters[0] *= 100
    network.parameters[1] *= 400
    network.parameters[2] *= 400
    want = [plain_chances(network.parameters, a)[t] for a, t in zip(context, target)]
    assert min(want) < -200 and not network.weights()[1] and np.allclose(network.forward(context, target)[3], want, rtol=1e-3)
    squares = [np.zeros_like(x) for x in network.parameters]
    assert np.allclose(network.step(context, target, squares).mean(), -np.mean(want), rtol=1e-3) and all(np.isfinite(x).all() for x in network.parameters)


def test_rare_words_of_a_block_keep_their_shares(spark):
    """Blocks number their rare words as they come; unseen words count as one."""
    text = " ".join(f"r{k} r{k % 7} c" for k in range(5000))
    docs = spark.createDataFrame([(1, text), (2, "r4999 c r1"), (3, "c"), (4, "never r2")], "doc_id long, text string").coalesce(1)
    counts = lm.word_counts(docs.where("doc_id < 4"))
    numbers, network = lm.train(docs, rounds=0, counts=counts)
    held = {bytes(r["word"]).decode(): r["n"] for r in counts.collect()}
    rare = sum(n for w, n in held.items() if w.encode() not in numbers)
    both = [{r["doc_id"]: r["log_likelihood"] for r in lm.score(docs, numbers, network, x).collect()} for x in (counts, None)]
    for doc, own in ((1, text), (2, "r4999 c r1"), (3, "c"), (4, "never r2")):
        want = sum(np.log(held.get(w, 1) / (rare + 1)) for w in own.split() if w.encode() not in numbers)
        assert both[0][doc] - both[1][doc] == pytest.approx(want, rel=1e-4)


def plain_grams(text):
    """The n-grams of a text as they are, without hashing."""
    words = text.encode().split()
    shapes = [(quality.classes(w), k > 0 and words[k - 1] == w) for k, w in enumerate(words)]
    grams = {("word", w) for w in words} | {("shape", x) for x in shapes} | set(zip(shapes, shapes[1:])) | set(zip(shapes, shapes[1:], shapes[2:]))
    for w in words:
        found = quality.classes(w)
        if len(found) > quality.WINDOW:
            grams |= {("window", found[k : k + quality.WINDOW]) for k in range(0, len(found), quality.WINDOW)}
    return grams


def test_quality_against_a_plain_version(spark):
    """Log-count ratios over all labelled rows, the scaled indicators, the hinge-loss model and its curve, on sets of n-grams."""
    rows = [(i, text, i % 2) for i, text, *_ in quality_rows(80)] + [(200, "a1b2-c3.d4,e5;f6:g7!h8?i9 " * 2, 0), (201, "Zürich 日本語、テキスト。です（はい）「ね」…よ・う！か？", 1)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    grams = [plain_grams(text) for _, text, _ in rows]
    y = np.array([label for *_, label in rows])
    every = sorted(set().union(*grams), key=repr)
    place = {g: k for k, g in enumerate(every)}
    n = np.ones((2, len(every)))
    for own, label in zip(grams, y):
        for g in own:
            n[label, place[g]] += 1
    ratios = np.log(n[1] / (y.sum() + 2)) - np.log(n[0] / ((1 - y).sum() + 2))

    def scaled(own):
        at = np.array(sorted(place[g] for g in own if g in place), int)
        return at, ratios[at] / np.sqrt(ratios[at] @ ratios[at])

    signs = np.where(y > 0, 1.0, -1.0)
    w = svm.fit([scaled(x) for x in grams], signs, len(every), svm.balanced_cost(signs, 10.0))
    margin = lambda own: w[scaled(own)[0]] @ scaled(own)[1] + w[-1]
    a, b = svm.calibrate(np.array([margin(x) for x in grams]), signs)
    of = quality.Features()
    for (_, text, _), own in zip(rows, grams):
        assert model.score(of(text)) == pytest.approx(1 / (1 + np.exp(-(a * margin(own) + b))), abs=5e-3)


def test_long_shapes_keep_all_their_parts():
    of = quality.Features()
    same = "x1-" * 20
    assert len(quality.windows((same + "?!").encode())) == 6 and quality.windows(b"plain") == []
    assert set(of(same + "end!")) != set(of(same + "end?")) and len(of("ab" * 500_000)) > 0


def plain_language(model, text):
    data = f" {text} ".encode().lower()
    counts = {}
    for i in range(len(data) - 2):
        key = (((data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA6B + data[i + 2] * 0xC2B2AE35) & 0xFFFFFFFF) >> 7) % langid.DIMS
        counts[key] = counts.get(key, 0) + 1
    total = sum(counts.values())
    margins = [sum(n * float(model.weights[k, m]) for k, n in counts.items()) / total + model.bias[m] for m in range(model.weights.shape[1])]
    sure = [1 / (1 + np.exp(-(a * m + b))) for m, (a, b) in zip(margins, model.curves)]
    families = dict(zip(model.families, sure)) if len(model.families) > 1 else {model.families[0]: 1.0}
    pairs = dict(zip(model.pairs, sure[len(sure) - len(model.pairs) :]))
    family = max(families, key=families.get)
    own = [x for x in model.langs if langid.family_of(x) == family]
    share = {}
    for x in own:
        against = [pairs[x, z] if (x, z) in pairs else 1 - pairs[z, x] for z in own if z != x]
        share[x] = 1 / max(sum(1 / p for p in against) - (len(own) - 2), 1.0)
    best = max(own, key=lambda x: share[x])
    return best, families[family] / sum(families.values()) * share[best] / sum(share.values())


def test_language_against_a_plain_version():
    rng = random.Random(3)
    langs = [*WORDS, "nl"] * 25
    words = WORDS | {"nl": "de het een niet met huis worden welke zou mensen water omdat".split()}
    texts = [sentence(rng, words[x]) for x in langs]
    model = langid.Model([langid.frequencies(x) for x in texts], langs)
    sparse = [tuple(np.frombuffer(b, t) for b, t in zip(langid.sparse(langid.frequencies(x)), (np.uint16, np.float32))) for x in texts]
    again = langid.Model([(at.astype(np.int64), x.astype(float)) for at, x in sparse], langs)
    assert np.allclose(model.weights, again.weights, atol=1e-3)
    for text in [*texts[:20], sentence(rng, words["en"] + words["fr"]), "ÄÖ ß", "x"]:
        lang, score = model.predict(text)
        want, sure = plain_language(model, text)
        assert score == pytest.approx(sure, abs=1e-4) and (lang == want or sure < 0.5)


def test_every_language_is_learnt(spark, monkeypatch):
    """Many languages of no listed family, blanks in their names: none is left out, and fewer texts of others are shared."""
    monkeypatch.setattr(langid, "REST", 120)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"own {k}": ["".join(rng.choice(rng.sample(letters, 26)[:9]) for _ in range(5)) for _ in range(6)] for k in range(40)}
    rows = [(i, sentence(rng, words[lang]), lang, "web", 0.0) for i, lang in enumerate([*words] * 12)]
    got = langid.language_of(spark.createDataFrame(rows, LANGUAGE)).collect()
    want = {i: lang for i, _, lang, *_ in rows}
    assert {r["lang_pred"] for r in got} == set(words)
    held = [r["lang_pred"] == want[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) >= 0.9 * len(held) > 50


def test_models_learnt_in_tasks_are_those_of_the_plain_version(spark):
    rows = [(i, text, lang) for i, text, lang, *_ in language_rows(160)]
    found = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sparse = [tuple(np.frombuffer(b, t) for b, t in zip(langid.sparse(langid.frequencies(x)), (np.uint16, np.float32))) for _, x, _ in rows]
    plain = langid.Model([(at.astype(np.int64), x.astype(float)) for at, x in sparse], [lang for *_, lang in rows])
    assert found.langs == plain.langs and found.pairs == plain.pairs
    assert np.allclose(found.weights, plain.weights, atol=1e-5) and np.allclose(found.bias, plain.bias) and np.allclose(found.curves, plain.curves)
