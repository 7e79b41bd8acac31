import random
import zlib

import numpy as np

from linkweave.llm.toxicity import (
    GRAM_DIM, GRAMS, HIDDEN, WINDOW, WORD_DIM, SampleBounds, _forward_backward, fit, held_out, labelled_sample, tokens_of, toxicity_report, windows_of, without_toxic,
)
from tests.llm.samples import docs, prose, texts

BAD = ["grumblor", "vexxil", "snarkon"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(seed * 10_000 + i, rng.randint(5, 200)).split()
        toxic = rng.random() < 0.4
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD) + rng.choice(["", "s", "ed"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy():
    train, test = corpus(800, 1), corpus(200, 2)
    model = fit([t for _, t, _ in train], [y for *_, y in train])
    scores = np.array(model.score([t for _, t, _ in test]))
    y = np.array([y for *_, y in test])
    assert ((scores >= 0.7) == y).mean() > 0.95
    again = fit([t for _, t, _ in train], [y for *_, y in train])
    assert np.allclose(again.score([t for _, t, _ in test]), scores)
    # a long clean text with one bad passage at its end is found: every window counts
    assert model.score([prose(99, 6000) + " vexxil grumblors"])[0] >= 0.7


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: rng.normal(0, 0.4, s) for k, s in (("u0", (HIDDEN, 3 * HIDDEN)), ("u1", (HIDDEN, 3 * HIDDEN)), ("attend", 2 * HIDDEN), ("out", 2 * HIDDEN), ("b", 1))}
    gates = rng.normal(0, 1, (9, 6 * HIDDEN))
    index = rng.integers(0, 8, (3, WINDOW))
    index[0, 20:] = 8
    pad, y = index == 8, np.array([1.0, 0.0, 1.0])

    def loss():
        from linkweave.llm import toxicity as t

        model = t.Model({}, {k: v.astype(np.float64) for k, v in w.items()})
        logit = np.array(model.window_logits(gates, index), float)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    grads, dx = _forward_backward(w, gates, index, pad, y)
    for name in ("u0", "u1", "attend", "out", "b"):
        flat = w[name].reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            old, h = flat[k], 1e-2
            flat[k] = old + h
            up = loss()
            flat[k] = old - h
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * h) - grads[name].reshape(-1)[k]) < 2e-3, name
    dgate = np.zeros_like(gates)
    np.add.at(dgate, index.ravel(), dx.reshape(-1, 6 * HIDDEN))
    gates[2, 5] += 1e-2
    up = loss()
    gates[2, 5] -= 2e-2
    assert abs((up - loss()) / 2e-2 - dgate[2, 5]) < 2e-3


def test_windows_cover_all_tokens():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        covered = {k for s in windows_of(n) for k in range(s, min(n, s + WINDOW))}
        assert covered == set(range(n))
    assert b"".join(tokens_of("abc" * 40)) == b"abc" * 40


def test_sample_leaves_out_held_out_rows(spark):
    given = docs(spark, [(i, t) for i, t, _ in corpus(300, 3)])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus(300, 3)] + [(None, 1, 1), (5, 0, None), (7, 0, 0), (9999, 1, 1)], "doc_id bigint, quality int, toxic int")
    sample, toxic = labelled_sample(given, labels, SampleBounds(10, 20, 1 << 20))
    allowed = {t for i, t, _ in corpus(300, 3) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(sample) <= allowed and len(sample) - sum(toxic) == 20 and 9 <= sum(toxic) <= 10  # 9999 has no text
    assert sum(len(t) for t in labelled_sample(given, labels, SampleBounds(10, 20, 3000))[0]) <= 3000


def test_report_and_filter(spark):
    data = corpus(800, 4)
    given = docs(spark, [(i, t) for i, t, _ in data] + [(9000, None), (9001, ""), (None, "plain words"), (9002, prose(5, 20_000))])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity_report(given, labels).collect()}
    assert len(found) == 804 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    assert all(r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    right = [found[i]["predicted"] == y for i, _, y in data if found[i]["held_out"]]
    assert sum(right) / len(right) > 0.9 and found[9000]["predicted"] == found[9001]["predicted"] == 0
    kept = without_toxic(given, labels)
    assert kept.columns == given.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}


def test_one_class_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert len(toxicity_report(docs(spark), labels).collect()) == len(texts())
    assert toxicity_report(docs(spark, []), labels).collect() == []


def plain_score(model, text):
    """The score by loops over tokens and cells, from the weights and the rules alone."""
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def inputs(token):
        vector = np.zeros(WORD_DIM + GRAM_DIM)
        if token is None:
            return w["bx"]
        vector[:WORD_DIM] = w["words"][model.words.get(token, 0)]
        cells, grams = bytes([2]) + token + bytes([3]), []
        for n in (3, 4, 5):
            for i in range(len(cells) - n + 1):
                h = 0
                for c in cells[i:i + n]:
                    h = (h * 2654435761 + c + n) % 2**32
                h = ((h ^ (h >> 15)) * 2246822519) % 2**32 >> 19
                grams.append(h % (GRAMS - 1) + 1)
        vector[WORD_DIM:] = sum((w["grams"][g] for g in grams), np.zeros(GRAM_DIM)) / max(len(grams), 1)
        return vector @ w["wx"] + w["bx"]

    tokens = tokens_of(text)
    logits = []
    for start in windows_of(len(tokens)):
        part = tokens[start:start + WINDOW]
        part = part + [None] * (WINDOW - len(part))
        xs, sides = [inputs(t) for t in part], []
        for d in (0, 1):
            h, states = np.zeros(HIDDEN), [None] * WINDOW
            for t in reversed(range(WINDOW)) if d else range(WINDOW):
                x, a = xs[t][d * 3 * HIDDEN:(d + 1) * 3 * HIDDEN], h @ w[f"u{d}"]
                z, r = sigmoid(x[:HIDDEN] + a[:HIDDEN]), sigmoid(x[HIDDEN:2 * HIDDEN] + a[HIDDEN:2 * HIDDEN])
                c = np.tanh(x[2 * HIDDEN:] + r * a[2 * HIDDEN:])
                h = z * h + (1 - z) * c
                states[t] = h
            sides.append(states)
        both = [np.concatenate([f, b]) for f, b in zip(*sides)]
        real = [t for t in range(WINDOW) if part[t] is not None] or list(range(WINDOW))
        share = np.exp([both[t] @ w["attend"] for t in real])
        pooled = sum(s * both[t] for s, t in zip(share / share.sum(), real))
        logits.append(pooled @ w["out"] + w["b"][0])
    return sigmoid(max(logits) + model.shift)


def test_scores_as_a_plain_loop():
    train = corpus(200, 3)
    model = fit([t for _, t, _ in train], [y for *_, y in train], epochs=3)
    given = [t for _, t in texts() if len(t or "") < 5000] + [t for _, t, _ in corpus(20, 4)] + [prose(98, 33), prose(97, 32), "a", "-"]
    assert np.allclose(model.score(given), [plain_score(model, t) for t in given], atol=2e-4)
