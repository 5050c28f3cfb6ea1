"""Models: held-out accuracy, by hand, and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from trigrail.llm import language_id, linear, quality, toxicity
from trigrail.llm import text as tx

SPEECH = {"en": "the of and to in is was that water house river".split(), "de": "der die und das nicht wasser haus fluss über schön".split(), "fr": "le la les des eau maison rivière être été pas".split()}


def say(rnd, lang, n):
    return " ".join(rnd.choice(SPEECH[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rnd = random.Random(2)
    rows = [(d, say(rnd, lang, rnd.randint(8, 60)), lang) for d in range(240) for lang in [rnd.choice([*SPEECH])]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 -- !!", "fr"), (903, say(rnd, "de", 60) + " " + say(rnd, "fr", 30), None), (904, say(rnd, "fr", 9000), None), (None, "x", "en")]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, n long, most string")


def test_languages(tongues):
    got = {r.doc_id: r for r in language_id.languages(tongues).collect()}
    rows = {r.doc_id: r for r in tongues.where("doc_id is not null").collect()}
    assert got.keys() == rows.keys()
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [d for d in range(240) if got[d].held_out]
    assert np.mean([got[d].lang_pred == rows[d].lang for d in held]) > 0.97
    assert [got[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred == "de" and got[903].n_langs == 2 and 0.5 < got[903].score < 0.85
    assert got[904].lang_pred == "fr" and got[904].n_langs == 1


def test_nothing_to_learn_or_predict(tongues):
    assert {r.lang_pred for r in language_id.languages(tongues.withColumn("lang", tongues.lang.substr(9, 1)).where("doc_id > 899").drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert language_id.languages(tongues.where("doc_id < 0")).count() == 0


def test_mixture_finds_known_proportions():
    p = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    c = 1000 * (p @ [0.25, 0.75])
    share, _ = language_id.mixture(p, c, np.zeros(3, int), np.array([0]), np.ones((1, 2)))
    for _ in range(20):
        share, _ = language_id.mixture(p, c, np.zeros(3, int), np.array([0]), share)
    assert np.allclose(share, [[0.25, 0.75]], atol=0.02)


@pytest.mark.parametrize("block", [8_000_000, 12])
def test_second_language_of_many(block, monkeypatch):
    """A second language in other letters, less likely than eleven others on the whole text, is in the mixture."""
    monkeypatch.setattr(language_id, "BLOCK", block, raising=False)
    rng = np.random.default_rng(7)
    p = np.full((12, 400), 1e-7)
    p[:11, :200] = rng.dirichlet(np.full(200, 5.0), 11)
    p[11, 200:] = rng.dirichlet(np.full(200, 5.0))
    p /= p.sum(1, keepdims=True)
    mixed = np.round(6000 * (0.75 * p[0] + 0.25 * p[11])).astype(int)
    rows = [(np.flatnonzero(c), c[c > 0]) for c in (mixed, np.round(6000 * p[3]).astype(int))]
    lang, share, size = language_id.infer(rows, np.log(p).astype(np.float32))
    assert lang.tolist() == [0, 3] and size.tolist() == [2, 1] and abs(share[0] - 0.75) < 0.03


@pytest.fixture(scope="module")
def talk(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for d in range(300):
        toxic = d % 4 == 0
        words = say(rnd, "en", rnd.randint(20, 80)).split()
        for _ in range(4 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["grumblesnot", "Zorkface", "blithering"]))
        rows.append((d, " ".join(words)))
        labels.append((d, 0, int(toxic)))
    rows += [(900, None), (901, ""), (902, "x"), (903, "Zorkface " * 5000), (None, "y")]
    labels += [(900, 1, 0), (5, 0, 0), (7, 1, None), (8888, 0, 1), (None, 0, 1)]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, toxic int, all string"), spark.createDataFrame([(*r, "l") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_toxicity(talk):
    docs, labels = talk
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got.keys() == {*range(300), 900, 901, 902, 903}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    assert np.mean([got[d].predicted == (d % 4 == 0) for d in range(300) if got[d].held_out]) > 0.97
    assert got[903].predicted == 1 and got[900].predicted == got[901].predicted == 0
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), labels).collect()}
    assert all(abs(again[d] - r.score) < 1e-6 for d, r in got.items())


def test_toxicity_without_both_labels(talk):
    docs, labels = talk
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, labels.where("doc_id < 0")).collect()} == {0.5}
    one = {round(r.score, 3) for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()}
    assert len(one) == 1 and one.pop() < 0.05
    assert toxicity.toxicity(docs.where("doc_id < 0"), labels).count() == 0


def test_character_ngrams_are_distinct():
    a, b, c = linear.character_ngrams(["abcabc", "ABC", ""], (3,), 18)
    assert len(a) == 3 and len(b) == 1 and len(c) == 0 and set(b) <= set(a)


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(4)
    rows = []
    for d in range(400):
        words = say(rnd, rnd.choice([*SPEECH]), rnd.randint(30, 90)).split()
        words = [w if rnd.random() < 0.3 else "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for w in words]
        bad = d % 5 == 0
        if bad:
            words = [[w + rnd.choice(["###", "$$$"]) for w in words], [w.upper() + "!!" for w in words], [x for w in words[:9] for x in [w] * 9], [x for w in words for x in (w + "xy", "|")]][d // 5 % 4]
        rows.append((d, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "### ###"), (904, "the water of the house " * 4 + "and that river was in it. " * 2), (905, "! " * 20000), (None, "x")]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, good int, pattern string")


def test_short_texts_with_faults_are_judged(mixed):
    short = {910: "water### house$$$ river### was$$$", 911: "water | house | river |", 912: "water house river", 913: "house"}
    rows = mixed.sparkSession.createDataFrame([(d, t, 1, "z") for d, t in short.items()], mixed.schema)
    got = {r.doc_id: r for r in quality.quality(mixed.unionByName(rows), keep=1.01).collect()}  # no score is enough
    assert [got[d].kept for d in short] == [False, False, True, True]
    blob = "QUJDREVGR0g" * 500
    raw = [blob.encode(), "行".encode() * 300, b"water house", b"", b"=" * 5000]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    assert quality.features(np.frombuffer(b"".join(raw), np.uint8), offs)[2].tolist() == [False, False, True, True, False]


def test_quality(mixed):
    got = {r.doc_id: r for r in quality.quality(mixed).collect()}
    assert got.keys() == {*range(400), *range(900, 906)}
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got.values())
    bad = [d for d in range(400) if d % 5 == 0]
    assert np.mean([not got[d].kept for d in bad]) > 0.95
    assert np.mean([got[d].kept for d in range(400) if d % 5]) > 0.995
    assert [got[d].kept for d in range(900, 906)] == [True, True, True, True, True, False]
    assert quality.quality(mixed.where("doc_id < 0")).count() == 0
    assert quality.quality(mixed.where("doc_id in (1, 900)")).count() == 2


def test_label_model_on_known_classes():
    rng = np.random.default_rng(1)
    n = 20000
    bad = rng.random(n) < 0.2
    fault = rng.integers(0, 3, n)
    votes = np.full((n, len(quality.LABELLERS)), quality.VOTE_GOOD)
    for j in range(3):
        hit = bad & (fault == j) & (rng.random(n) < 0.95) | ~bad & (rng.random(n) < 0.003)
        votes[hit, j] = quality.VOTE_BAD
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, like, prior = quality.label_model(patterns, counts.astype(float))
    assert ((good[which.ravel()] < 0.5) == bad).mean() > 0.97
    assert np.isclose(prior.sum(), 1) and np.allclose(like.sum(2), 1)


def test_label_model_recovers_accuracies():
    """Planted shares of bad votes, far from the priors, come back from votes alone."""
    rng = np.random.default_rng(3)
    n, m = 400_000, len(quality.LABELLERS)
    kind = rng.choice(m + 1, n, p=[0.85, 0.06, 0.05, 0.04, *[0.0] * (m - 3)])
    hit = np.full((m + 1, m), 0.001)
    hit[0, :4] = 0.004, 0.002, 0.003, 0.001  # false alarms
    hit[1, [0, 3, 4]], hit[2, [1, 5]], hit[3, [2, 6]] = [0.8, 0.5, 0.3], [0.95, 0.4], [0.7, 0.6]  # a fault's own labeller, and others that see it too
    votes = np.where(rng.random((n, m)) < hit[kind], quality.VOTE_BAD, quality.VOTE_GOOD)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, like, prior = quality.label_model(patterns, counts.astype(float))
    bad = good[which.ravel()] < 0.5
    each = np.where(patterns[:, None, :] == quality.VOTE_BAD, hit, 1 - hit).prod(2) * [0.85, 0.06, 0.05, 0.04, *[0.0] * (m - 3)]
    best = (each[:, 0] < each[:, 1:].sum(1))[which.ravel()]  # by the shares that the votes were drawn with
    assert (bad == (kind > 0)).mean() > (best == (kind > 0)).mean() - 0.01
    assert np.abs(like[0, :, quality.VOTE_BAD] - hit[0]).max() < 0.005 and abs(prior[0] - 0.85) < 0.02
    for own in range(3):  # texts that no labeller sees are out of reach: of those that any sees, the share that the own one does
        seen = (votes[kind == own + 1] == quality.VOTE_BAD).any(1).mean()
        assert abs(like[own + 1, own, quality.VOTE_BAD] - hit[own + 1, own] / seen) < 0.12


def test_scores_like_plain_code(mixed):
    """The scorer's scores are those of its features and weights, text by text; a posterior is that of the text's votes."""
    seen = {}
    train = linear.train

    def spy(rows, target, weight, size, **more):
        seen["target"], seen["weight"] = target, weight
        return train(rows, target, weight, size, **more)

    texts = ["the water of the house and that river was in it " * 3, "xx### yy$$$ " * 20, "word " * 30]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    rows = quality.features(np.frombuffer(b"".join(raw), np.uint8), offs)[0]
    w, bias = spy(rows, np.array([1.0, 0.0, 0.0]), np.array([2.0, 0.5, 0.5]), 1 << quality.BITS, rate=0.3)
    alone = [linear.sigmoid(np.array([sum(float(w[i]) * float(v) for i, v in zip(*r, strict=True)) + bias]))[0] for r in rows]
    assert alone[0] > 0.5 > max(alone[1:])
    for k, r in enumerate(raw):  # features don't depend on what else is in the step
        one = quality.features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0][0]
        assert (one[0] == rows[k][0]).all() and np.allclose(one[1], rows[k][1])


def test_statistics_by_hand():
    texts = ["AB cd cd 12 ##x !", "", "the x\nthis line is repeated here\nthis line is repeated here"]
    raw = "".join(texts).encode()
    offs = np.cumsum([0, *map(len, texts)])
    stats, n, *_ = quality.statistics(np.frombuffer(raw, np.uint8), offs)
    row = dict(zip(quality.STATS, stats[0], strict=True))
    assert n.tolist() == [6, 0, 12]
    assert np.isclose(row["symbols"], 1 / 6) and np.isclose(row["bare"], 1 / 6) and np.isclose(row["again"], 1 / 6) and np.isclose(row["upper"], 2 / 7) and np.isclose(row["commonest"], 2 / 6) and np.isclose(row["shouts"], 1 / 6)
    assert not stats[1, :-1].any() and np.isclose(dict(zip(quality.STATS, stats[2], strict=True))["lines"], 0.5)


def test_training_is_the_same_every_time():
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 50, 5), np.ones(5)) for _ in range(60)]
    y = np.array([float((r[0] < 10).any()) for r in rows])
    one, two = (linear.train(rows, y, np.ones(60), 50) for _ in range(2))
    assert (one[0] == two[0]).all() and one[1] == two[1]
    assert tx.mix(np.zeros(1, np.uint64)).dtype == np.uint64


def test_small_samples_get_as_many_steps():
    """steps is a least number of batches: a small sample is learned as far as a larger one, and a large one's epochs don't change."""
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 50, 5), np.ones(5)) for _ in range(60)]
    y = np.array([float((r[0] < 10).any()) for r in rows])

    def loss(model):
        p = np.array([linear.sigmoid(np.array([model[0][r].sum() + model[1]]))[0] for r, _ in rows])
        return -np.log(np.where(y == 1, p, 1 - p)).mean()

    few, many = (linear.train(rows, y, np.ones(60), 50, epochs=2, steps=n) for n in (0, 200))
    assert loss(many) < loss(few) / 2
    same, again = (linear.train(rows, y, np.ones(60), 50, batch=1, steps=n) for n in (0, 1200))
    assert (same[0] == again[0]).all() and same[1] == again[1]
    assert not linear.train([], np.zeros(0), np.zeros(0), 50, steps=10)[0].any()
