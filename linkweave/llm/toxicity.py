"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, in numpy.

A text is cut into tokens (words; words over 16 bytes in pieces of 16), the tokens into
windows of 32 that overlap by half, and every window is scored:

    x_t = [word vector, mean of the vectors of the token's hashed character 3-, 4-, 5-grams]
    h_t = [GRU forward, GRU backward](x)
    logit = w . sum_t softmax_t(u . h_t) h_t + b

The score of a text is that of its worst window. Labels belong to whole texts, so training
takes the worst window of a toxic text as the toxic one (at first the one with the most
telling token) and all kinds of windows of clean texts, the worst among them.

The model is fitted on the driver, on a bounded sample of labelled rows (``SampleBounds``), and
broadcast (about half a megabyte, whatever the data). Scoring is a pass over Arrow batches:
gate inputs are computed once per distinct token and then looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from linkweave.llm.common import small_batches, unused, words_of

WINDOW, STRIDE = 32, 16
WIDTH = 16  # bytes of a token
HIDDEN, WORD_DIM, GRAM_DIM = 8, 8, 12
WORDS, GRAMS = 2000, 1 << 13
REJECT_AT = 0.7
SEED = 11
_BATCH_WINDOWS = 2048
_CACHE_TOKENS = 100_000


@dataclass(frozen=True)
class SampleBounds:
    """What the fit may read: so many labelled rows of each class, and bytes of text in all."""

    toxic: int = 1500
    clean: int = 3000
    text_bytes: int = 24 << 20


def tokens_of(text: str | None) -> list[bytes]:
    """Words, long ones in pieces, so that every byte of every word is read."""
    words = words_of(text)
    if any(len(w) > WIDTH for w in words):
        return [w[i:i + WIDTH] for w in words for i in range(0, len(w), WIDTH)]
    return words


def _grams(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram of every token (0: none), and 1 / their number."""
    flat = np.zeros((len(tokens), WIDTH + 2), np.uint8)
    flat[:, 0] = 2
    flat[:, 1:WIDTH + 1] = np.array(tokens, f"S{WIDTH}").view(np.uint8).reshape(len(tokens), WIDTH)
    end = (flat[:, 1:] != 0).sum(1) + 1
    flat[np.arange(len(tokens)), end] = 3
    wide = flat.astype(np.uint32)
    found = []
    for n in (3, 4, 5):
        h = np.zeros((len(tokens), WIDTH + 3 - n), np.uint32)
        for k in range(n):
            h = h * np.uint32(2654435761) + wide[:, k:k + h.shape[1]] + np.uint32(n)
        bucket = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(19)
        found.append(np.where(wide[:, n - 1:] > 0, bucket % np.uint32(GRAMS - 1) + np.uint32(1), 0).astype(np.uint16))
    buckets = np.concatenate(found, 1)
    return buckets, (1.0 / np.maximum((buckets > 0).sum(1), 1)).astype(np.float32)


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n tokens; the last one ends at the last token."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


@dataclass
class Model:
    """Weights of the network; ``score`` is all that scoring needs."""

    words: dict[bytes, int]
    weights: dict[str, np.ndarray]
    shift: float = 0.0
    _cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"words": self.words, "weights": self.weights, "shift": self.shift, "_cache": {}}

    def gate_inputs(self, tokens: list[bytes], padding: bool = False) -> np.ndarray:
        """Input parts of all gates, both directions, per token; with those of padding as the last row."""
        w = self.weights
        out = np.empty((len(tokens) + padding, 6 * HIDDEN), np.float32)
        out[len(tokens):] = w["bx"]
        for at in range(0, len(tokens), 1 << 15):
            part = tokens[at:at + (1 << 15)]
            ids = np.fromiter((self.words.get(t, 0) for t in part), np.int64, len(part))
            buckets, scale = _grams(part)
            grams = np.zeros((len(part), GRAM_DIM), np.float32)
            for k in range(buckets.shape[1]):
                grams += w["grams"][buckets[:, k]]
            x = np.concatenate([w["words"][ids], grams * scale[:, None]], 1)
            out[at:at + len(part)] = x @ w["wx"] + w["bx"]
        return out

    def window_logits(self, gates: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logit per window; ``index`` (windows, WINDOW) points into ``gates``, its last row is padding."""
        w, pad = self.weights, len(gates) - 1
        out = np.empty(len(index), np.float32)
        for at in range(0, len(index), _BATCH_WINDOWS):
            ix = index[at:at + _BATCH_WINDOWS]
            states = np.concatenate([_run(gates[:, d * 3 * HIDDEN:(d + 1) * 3 * HIDDEN], ix, w[f"u{d}"], d) for d in (0, 1)], 2)
            e = states @ w["attend"]
            e[ix.T == pad] = -1e9
            e = np.exp(e - e.max(0))
            pooled = np.einsum("tb,tbh->bh", e / e.sum(0), states)
            out[at:at + len(ix)] = pooled @ w["out"] + w["b"][0]
        return out

    def forget(self) -> None:
        """Drop what was kept of the tokens scored so far."""
        self._cache.clear()
        self._gates = []

    def score(self, texts: list[str | None]) -> list[float]:
        """Score of the worst window of every text; a text without tokens gets that of padding."""
        index, owner, known = [], [], self._cache
        if len(known) > _CACHE_TOKENS:
            known.clear()
        if not known:
            self._gates = [np.zeros((1, 6 * HIDDEN), np.float32)]
            self._gates[0][:] = self.weights["bx"]
        new: list[bytes] = []
        first = len(known) + 1
        for i, text in enumerate(texts):
            ids = []
            for t in tokens_of(text):
                at = known.get(t)
                if at is None:
                    at = known[t] = first + len(new)
                    new.append(t)
                ids.append(at)
            ids = np.array(ids or [0], np.int64)
            starts = windows_of(len(ids))
            rows = np.zeros((len(starts), WINDOW), np.int64)
            if len(ids) < WINDOW:
                rows[0, :len(ids)] = ids
            else:
                rows[:] = ids[np.add.outer(np.array(starts), np.arange(WINDOW))]
            index.append(rows), owner.append(np.full(len(starts), i))
        if new:
            self._gates = [np.concatenate([self._gates[0], self.gate_inputs(new)])]
        # Padding is row 0 here; the network wants it last.
        gates = np.concatenate([self._gates[0], self._gates[0][:1]])
        index, owner = np.concatenate(index), np.concatenate(owner)
        index[index == 0] = len(gates) - 1
        logits = self.window_logits(gates, index)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, logits)
        return (1 / (1 + np.exp(-np.clip(worst + self.shift, -40, 40)))).tolist()


def _run(gates: np.ndarray, index: np.ndarray, u: np.ndarray, backward: int) -> np.ndarray:
    """States of one direction, (WINDOW, windows, HIDDEN)."""
    h = np.zeros((len(index), HIDDEN), np.float32)
    states = np.empty((WINDOW, len(index), HIDDEN), np.float32)
    for t in range(WINDOW - 1, -1, -1) if backward else range(WINDOW):
        x = gates[index[:, t]]
        a = h @ u
        zr = np.tanh(0.5 * (x[:, :2 * HIDDEN] + a[:, :2 * HIDDEN])) * 0.5 + 0.5
        n = np.tanh(x[:, 2 * HIDDEN:] + zr[:, HIDDEN:] * a[:, 2 * HIDDEN:])
        h = n + zr[:, :HIDDEN] * (h - n)
        states[t] = h
    return states


def _forward_backward(w: dict, gates: np.ndarray, index: np.ndarray, pad: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean cross-entropy over a batch of windows: weights, and gate inputs."""
    n, grads = len(index), {}
    kept, states = [], []
    for d in (0, 1):
        x, u = gates[:, d * 3 * HIDDEN:(d + 1) * 3 * HIDDEN], w[f"u{d}"]
        h = np.zeros((n, HIDDEN), np.float32)
        tape, out = {}, np.empty((WINDOW, n, HIDDEN), np.float32)
        for t in range(WINDOW - 1, -1, -1) if d else range(WINDOW):
            a = h @ u
            xt = x[index[:, t]]
            zr = np.tanh(0.5 * (xt[:, :2 * HIDDEN] + a[:, :2 * HIDDEN])) * 0.5 + 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            hn = a[:, 2 * HIDDEN:]
            c = np.tanh(xt[:, 2 * HIDDEN:] + r * hn)
            tape[t] = (h, z, r, hn, c)
            h = c + z * (h - c)
            out[t] = h
        kept.append(tape), states.append(out)
    s = np.concatenate(states, 2)
    e = s @ w["attend"]
    e[pad.T] = -1e9
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, s)
    p = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["b"][0], -40, 40)))
    dl = ((p - y) / n).astype(np.float32)
    grads["out"], grads["b"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
    dpool = np.outer(dl, w["out"])
    da = np.einsum("tbh,bh->tb", s, dpool)
    de = a * (da - (a * da).sum(0))
    grads["attend"] = np.einsum("tb,tbh->h", de, s)
    ds = a[:, :, None] * dpool + de[:, :, None] * w["attend"]
    dx = np.empty((n, WINDOW, 6 * HIDDEN), np.float32)
    for d in (0, 1):
        u, du = w[f"u{d}"], np.zeros_like(w[f"u{d}"])
        dh = np.zeros((n, HIDDEN), np.float32)
        for t in range(WINDOW) if d else range(WINDOW - 1, -1, -1):
            h, z, r, hn, c = kept[d][t]
            g = dh + ds[t][:, d * HIDDEN:(d + 1) * HIDDEN]
            dz = g * (h - c) * z * (1 - z)
            dc = g * (1 - z) * (1 - c * c)
            dr = dc * hn * r * (1 - r)
            da_ = np.concatenate([dz, dr, dc * r], 1)
            du += h.T @ da_
            dh = g * z + da_ @ u.T
            dx[:, t, d * 3 * HIDDEN:(d + 1) * 3 * HIDDEN] = np.concatenate([dz, dr, dc], 1)
        grads[f"u{d}"] = du
    return grads, dx


def fit(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = 8, batch: int = 256) -> Model:
    """Train on whole labelled texts. Without both labels the score is the share of toxic ones."""
    rng = np.random.default_rng(seed)
    docs, vocabulary = _token_ids(texts)
    y_doc = np.array(labels, np.int64)
    counts = np.bincount(np.concatenate(docs), minlength=len(vocabulary)) if docs else np.zeros(0, np.int64)
    frequent = [vocabulary[i] for i in np.lexsort((np.arange(len(vocabulary)), -counts))[:WORDS]]
    dim = WORD_DIM + GRAM_DIM
    w = {
        "words": rng.normal(0, 0.1, (len(frequent) + 1, WORD_DIM)), "grams": rng.normal(0, 0.3, (GRAMS, GRAM_DIM)),
        "wx": rng.normal(0, 1 / math.sqrt(dim), (dim, 6 * HIDDEN)), "bx": np.zeros(6 * HIDDEN),
        "u0": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), "u1": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)),
        "attend": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "b": np.array([-1.0]),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["grams"][0] = 0
    model = Model({t: i + 1 for i, t in enumerate(frequent)}, w)
    if len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        w["out"][:] = 0
        w["b"][0] = math.log(share / (1 - share))
        return model

    word_ids = np.array([model.words.get(t, 0) for t in vocabulary])
    parts = [_grams(vocabulary[a:a + (1 << 15)]) for a in range(0, len(vocabulary), 1 << 15)]
    buckets, scale = (np.concatenate(p) for p in zip(*parts)) if parts else _grams([])
    del parts
    pad_id = len(vocabulary)
    index, owner = [], []
    for i, ids in enumerate(docs):
        ids = ids if len(ids) else np.array([pad_id], np.int32)
        for start in windows_of(len(ids)):
            row = np.full(WINDOW, pad_id, np.int32)
            part = ids[start:start + WINDOW]
            row[:len(part)] = part
            index.append(row), owner.append(i)
    index, owner = np.array(index), np.array(owner)
    y_window = y_doc[owner]

    # The first guess at the toxic window of a toxic text: the one with the most telling token or its start.
    telling = _telling(docs, y_doc, vocabulary)
    worth = np.append(telling, -9.0)[index].max(1)

    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        if epoch >= 2:
            gates = model.gate_inputs(vocabulary, padding=True)
            worth = model.window_logits(gates, index)
        order = np.lexsort((rng.random(len(index)), -worth, owner))
        ranked = owner[order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        toxic = order[(y_window[order] == 1) & (rank == 0)]
        clean = order[(y_window[order] == 0) & (rank < 2)]
        others = np.flatnonzero(y_window == 0)
        others = rng.choice(others, min(len(others), 4 * len(toxic)), replace=False)
        clean = np.concatenate([clean, others])
        chosen = np.concatenate([toxic, toxic, clean])
        rng.shuffle(chosen)
        rate = 0.02 * (0.5 ** (epoch / 3))
        for at in range(0, len(chosen), batch):
            rows = chosen[at:at + batch]
            used, ix = np.unique(index[rows], return_inverse=True)
            ix = ix.reshape(len(rows), WINDOW)
            real = used < pad_id
            ids = np.where(real, word_ids[np.minimum(used, pad_id - 1)], 0)
            ids = np.where(rng.random(len(ids)) < 0.3, 0, ids)  # so that characters must carry it too
            bk = np.where(real[:, None], buckets[np.minimum(used, pad_id - 1)], 0)
            sc = np.where(real, scale[np.minimum(used, pad_id - 1)], 0).astype(np.float32)[:, None]
            x = np.concatenate([w["words"][ids], w["grams"][bk].sum(1) * sc], 1)
            x[~real] = 0
            grads, dx = _forward_backward(w, x @ w["wx"] + w["bx"], ix, index[rows] == pad_id, y_window[rows].astype(np.float32))
            flat, dgate = ix.ravel(), np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(dgate, flat, dx.reshape(-1, 6 * HIDDEN))
            grads["wx"], grads["bx"] = x.T @ dgate, dgate.sum(0)
            dxin = (dgate @ w["wx"].T) * real[:, None]
            grads["words"], grads["grams"] = np.zeros_like(w["words"]), np.zeros_like(w["grams"])
            np.add.at(grads["words"], ids, dxin[:, :WORD_DIM])
            spread = np.repeat((dxin[:, WORD_DIM:] * sc)[:, None], bk.shape[1], 1)
            np.add.at(grads["grams"], bk.ravel(), spread.reshape(-1, GRAM_DIM))
            grads["grams"][0] = 0
            step += 1
            for k, g in grads.items():
                m, v = adam[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    gates = model.gate_inputs(vocabulary, padding=True)
    worst = np.full(len(docs), -np.inf)
    np.maximum.at(worst, owner, model.window_logits(gates, index))
    model.shift = math.log(REJECT_AT / (1 - REJECT_AT)) - _best_cut(worst, y_doc)
    return model


def _token_ids(texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
    """Every text as numbers into the sorted vocabulary; no token is held twice."""
    seen: dict[bytes, int] = {}
    docs = [np.array([seen.setdefault(t, len(seen)) for t in tokens_of(text)], np.int32) for text in texts]
    vocabulary = sorted(seen)
    place = np.empty(len(seen), np.int32)
    for i, t in enumerate(vocabulary):
        place[seen[t]] = i
    return [place[ids] for ids in docs], vocabulary


def _telling(docs: list[np.ndarray], y: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
    """Per token: the largest log-odds of itself and of its first 4 and 5 bytes over the classes of texts."""
    n = {label: int((y == label).sum()) for label in (0, 1)}
    best = np.full(len(vocabulary), -np.inf)
    for cut in (WIDTH, 4, 5):
        keys: dict[bytes, int] = {}
        key = np.array([keys.setdefault(t[:cut], len(keys)) for t in vocabulary], np.int32)
        held = {0: np.zeros(len(keys), np.int64), 1: np.zeros(len(keys), np.int64)}
        for ids, label in zip(docs, y):
            held[int(label)][np.unique(key[ids])] += 1
        odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
        best = np.maximum(best, odds[key])
    return best.astype(np.float32)


def _best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut that makes the fewest mistakes on the sample; in the middle of the gap it falls in."""
    order = np.argsort(logits)
    values, toxic = logits[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum((1 - toxic)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    if k == 0 or k == len(values):
        return float(values[0] - 1 if k == 0 else values[-1] + 1)
    return float((values[k - 1] + values[k]) / 2)


def held_out(doc_id) -> F.Column:
    """Whether the CRC-32 of the id as text has remainder 1 by 3; rows without an id are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, bounds: SampleBounds = SampleBounds()) -> tuple[list[str], list[int]]:
    """Texts and labels for the fit, none of them held out.

    Ids are taken in the order of a hash of the id until the bounds are reached; an id with
    several labels counts as toxic if one of them is, an id with several texts by its least.
    """
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = ids.withColumn("turn", F.xxhash64("doc_id"))
    # limits of a top-k: the documented bound of the sample
    chosen = ids.where("toxic = 1").orderBy("turn", "doc_id").limit(bounds.toxic).unionByName(
        ids.where("toxic = 0").orderBy("turn", "doc_id").limit(bounds.clean)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    found = texts.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # at most toxic + clean rows
    sizes = found.groupBy("doc_id", "toxic", "turn").agg(F.min(F.octet_length("text")).alias("size")).collect()
    within, used = [], 0
    for row in sorted(sizes, key=lambda r: (r["turn"], r["doc_id"])):
        if used + row["size"] <= bounds.text_bytes:
            used += row["size"]
            within.append(row["doc_id"])
    if not within:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in within], "doc_id bigint")
    least = F.min(F.struct(F.octet_length("text").alias("size"), F.col("text")))
    rows = found.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic", "turn").agg(least["text"].alias("text")).collect()
    rows.sort(key=lambda r: (r["turn"], r["doc_id"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def fit_on(docs: DataFrame, labels: DataFrame, bounds: SampleBounds = SampleBounds()) -> Model:
    texts, toxic = labelled_sample(docs, labels, bounds)
    return fit(texts, toxic)


def with_scores(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column: the score of the whole text (null and empty: that of padding)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        try:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for at, size in _slices(texts):
                    part = batch.slice(at, size)
                    values = pa.array(model.score(texts.slice(at, size).to_pylist()), pa.float64())
                    yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*batch.schema.names, name])
        finally:
            model.forget()  # the worker keeps the broadcast model for as long as it lives

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def _slices(texts: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most_bytes`` of text, one row at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text.as_buffer()) if text.is_valid else 0
        if i > start and held + size > most_bytes:
            yield start, i - start
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts) - start


def toxicity_report(docs: DataFrame, labels: DataFrame, bounds: SampleBounds = SampleBounds()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; repeated rows each give one."""
    model = fit_on(docs, labels, bounds)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return with_scores(rows, model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, bounds: SampleBounds = SampleBounds()) -> DataFrame:
    """The rows of ``docs`` that score below the cut, with all their columns."""
    name = unused(docs, "score")[0]
    scored = with_scores(docs, fit_on(docs, labels, bounds), name)
    return scored.where(F.col(name) < REJECT_AT).select(*[F.col(f"`{c}`") for c in docs.columns])
