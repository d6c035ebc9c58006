"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased and cut into words at ASCII characters that are neither letters nor
digits. A word's input is its hashed embedding beside the scaled sum of the embeddings of its
hashed character 4-grams, its edges included. Windows of `SPAN` words overlap by `SPAN -
STRIDE`; a GRU reads each in both directions, attention pools its states, and a logistic
layer scores it. A text's score is that of its highest window. All windows of all texts are
scored, in batches over all texts of a slice.

Training is multiple-instance: of a labelled text only its label is known, so each epoch takes
the windows that the present model scores highest, plus random ones of clean texts, and fits
them by Adam with gradients through time. Embeddings start from the log odds of words and
4-grams in the training texts. The sample is bounded: at most `TRAIN_DOCS` labelled texts a
class of at most `TRAIN_CHARS` characters, chosen by hash; scoring has no bounds.

Defined cases: texts without words, empty or null, get the training share of toxic texts
(below one half); of contradicting labels of a document 1 counts, of several texts the last; without labels of both classes every text gets that share; repeated rows
score alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, STRIDE = 40, 30
WORD_SLOTS, GRAM_SLOTS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 14, 8, 8, 8
TRAIN_DOCS, TRAIN_CHARS, EPOCHS, BATCH, MIN_STEPS = 2000, 20_000, 10, 64, 500

_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts: distinct ones with their features, and each text's word numbers."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"  " + b" ".join(raw) + b"   ", np.uint8)
        gap = _BREAK[data]
        data = np.where(gap, np.uint8(32), data)
        edge = np.diff(gap.astype(np.int8))
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        begins = 2 + np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))])
        cut = np.searchsorted(start, begins)
        self.first, self.count = cut[:-1], np.diff(cut)
        n = len(data)
        weighted = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
        h = (weighted[end] - weighted[start]) * _powers(_BACK, n)[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        _, at, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.slot = (h[at] >> np.uint64(50)).astype(np.int64)
        wide = data.astype(np.uint32)
        gram = wide[:-3] * np.uint32(0x9E3779B1) ^ wide[1:-2] * np.uint32(0x85EBCA6B) ^ wide[2:-1] * np.uint32(0xC2B2AE35) ^ wide[3:] * np.uint32(0x27D4EB2F)
        gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
        size = np.maximum(end[at] - start[at] - 1, 1)  # 4-grams of the word with a gap on both sides
        self.offset = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(start[at] - 1 - self.offset[:-1], size) + np.arange(self.offset[-1])
        self.grams = gram[place].astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (windows, SPAN), -1 behind the end of a text, and the text of each window."""
        n = np.where(self.count > 0, np.maximum(0, -(-(self.count - SPAN) // STRIDE)) + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        place = (self.first[text] + k * STRIDE)[:, None] + np.arange(SPAN)
        inside = place < (self.first + self.count)[text][:, None]
        return np.where(inside, self.of[np.where(inside, place, 0)] if len(self.of) else -1, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The weights, scoring and training; float32 throughout."""

    def __init__(self, seed: int = 2):
        g = np.random.default_rng(seed)
        f = lambda *s, by=0.3: (g.standard_normal(s) * by).astype(np.float32)
        self.base = 0.1
        self.p = {
            "word": f(WORD_SLOTS, DIM, by=0.02), "gram": f(GRAM_SLOTS, DIM, by=0.02), "W": f(2 * DIM, 6 * HIDDEN), "bW": f(6 * HIDDEN, by=0),
            "U": f(2, HIDDEN, 3 * HIDDEN), "A": f(2 * HIDDEN, ATTEND), "bA": f(ATTEND, by=0), "v": f(ATTEND), "w": f(2 * HIDDEN), "b": f(1, by=0),
        }

    def inputs(self, words: Words, some: np.ndarray | None = None):
        """The word inputs of distinct words `some` (all), with what the gradient needs."""
        some = np.arange(len(words.slot)) if some is None else some
        size = words.offset[some + 1] - words.offset[some]
        cuts = np.cumsum(size) - size
        grams = words.grams[np.repeat(words.offset[some] - cuts, size) + np.arange(size.sum())] if len(some) else np.zeros(0, np.int64)
        scale = (1 / np.sqrt(size)).astype(np.float32)[:, None]
        c = np.add.reduceat(self.p["gram"][grams], cuts, axis=0) * scale if len(some) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.p["word"][words.slot[some]], c], axis=1), (some, size, grams, scale, cuts)

    def forward(self, x: np.ndarray, index: np.ndarray, trace: list | None = None):
        """Logits of windows index (n, SPAN) into the word inputs x; -1 is no word."""
        p, n, T, H = self.p, len(index), index.shape[1], HIDDEN
        gates = np.concatenate([x @ p["W"] + p["bW"], np.zeros((1, 6 * H), np.float32)])  # the last row: no word
        h = np.zeros((2, n, H), np.float32)
        states = np.empty((2, T, n, H), np.float32)
        there = (index >= 0).astype(np.float32)
        for t in range(T):
            u = T - 1 - t
            g = np.stack([gates[index[:, t], : 3 * H], gates[index[:, u], 3 * H :]])
            m = np.stack([there[:, t], there[:, u]])[:, :, None]
            a = h @ p["U"]
            zr = _sigmoid(g[:, :, : 2 * H] + a[:, :, : 2 * H])
            z, r = zr[:, :, :H] * m, zr[:, :, H:]
            c = np.tanh(g[:, :, 2 * H :] + r * a[:, :, 2 * H :])
            if trace is not None:
                trace.append((h, zr, c, a[:, :, 2 * H :], m))
            h = h + z * (c - h)
            states[0, t], states[1, u] = h[0], h[1]
        s = np.concatenate([states[0], states[1]], axis=2)  # (T, n, 2H)
        q = np.tanh(s @ p["A"] + p["bA"])
        e = q @ p["v"] + (there.T - 1) * 1e9
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = (alpha[:, :, None] * s).sum(axis=0)
        logit = pooled @ p["w"] + p["b"][0]
        return (logit, s, q, alpha, pooled, gates) if trace is not None else logit

    def gradients(self, words: Words, index: np.ndarray, y: np.ndarray, weight: np.ndarray):
        p, H, T = self.p, HIDDEN, index.shape[1]
        some, at = np.unique(index, return_inverse=True)
        at = at.reshape(index.shape) - (some[0] < 0)
        x, (_, size, grams, scale, _) = self.inputs(words, some[some >= 0])
        trace: list = []
        logit, s, q, alpha, pooled, gates = self.forward(x, at, trace)
        d = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["w"]
        ds = alpha[:, :, None] * dp
        da = (s * dp).sum(axis=2)
        de = alpha * (da - (alpha * da).sum(axis=0))
        g["v"] = np.tensordot(de, q, 2)
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["A"], g["bA"] = np.tensordot(s, dq, ([0, 1], [0, 1])), dq.sum(axis=(0, 1))
        ds = ds + dq @ p["A"].T
        dg = np.zeros_like(gates)
        g["U"] = np.zeros_like(p["U"])
        dh = np.zeros((2, len(index), H), np.float32)
        for t in range(T - 1, -1, -1):
            u = T - 1 - t
            dh = dh + np.stack([ds[t, :, :H], ds[u, :, H:]])
            h, zr, c, ac, m = trace[t]
            z, r = zr[:, :, :H], zr[:, :, H:]
            dz = dh * (c - h) * m * z * (1 - z)
            dc = dh * z * m * (1 - c * c)
            dr = dc * ac * r * (1 - r)
            d_in = np.concatenate([dz, dr, dc], axis=2)
            d_rec = np.concatenate([dz, dr, dc * r], axis=2)
            g["U"] += h.transpose(0, 2, 1) @ d_rec
            dh = dh * (1 - z * m) + d_rec @ p["U"].transpose(0, 2, 1)
            np.add.at(dg[:, : 3 * H], at[:, t], d_in[0])
            np.add.at(dg[:, 3 * H :], at[:, u], d_in[1])
        dg = dg[:-1]
        g["W"], g["bW"] = x.T @ dg, dg.sum(axis=0)
        dx = dg @ p["W"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], words.slot[some[some >= 0]], dx[:, :DIM])
        np.add.at(g["gram"], grams, np.repeat(dx[:, DIM:] * scale, size, axis=0))
        return g

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 2) -> None:
        g = np.random.default_rng(seed)
        y = np.asarray(y, np.float32)
        self.base = float(min(0.49, (y.sum() + 0.5) / (len(y) + 1.0)))
        if not 0 < y.sum() < len(y):  # nothing to tell apart: every text scores the share
            self.p["w"][:], self.p["b"][:] = 0, np.log(self.base / (1 - self.base))
            return
        words = Words(texts)
        index, text = words.windows()
        for name, slots, rows, value in (
            ("word", words.slot[words.of], np.repeat(np.arange(len(texts)), words.count), 1.0),
            ("gram", *self._grams(words, len(texts)), 1.0),
        ):
            size = len(self.p[name])
            seen = np.unique(rows.astype(np.int64) * size + slots)
            in_bad = np.bincount(seen % size, y[seen // size], minlength=size)
            in_all = np.bincount(seen % size, minlength=size)
            odds = np.log((in_bad + 0.5 * y.mean()) / (y.sum() + 0.5)) - np.log((in_all - in_bad + 0.5) / (len(y) - y.sum() + 0.5))
            self.p[name][:, 0] = np.clip(value * odds * (in_all > 1), -3, 3)
            # and how sure that is: the root of the likelihood ratio, which rare slots cannot reach by chance
            share = y.mean()
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.nan_to_num(in_bad * np.log(in_bad / (in_all * share))) + np.nan_to_num((in_all - in_bad) * np.log((in_all - in_bad) / (in_all * (1 - share))))
            self.p[name][:, 1] = np.clip(np.sign(odds) * np.sqrt(np.maximum(0, 2 * ratio)) / 3, -3, 3)
        m, v, step = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        epochs = max(epochs, min(60, -(-MIN_STEPS * BATCH // (3 * len(texts)))))  # few texts need more rounds
        for epoch in range(epochs):
            x, _ = self.inputs(words)
            logit = np.concatenate([self.forward(x, index[i : i + 2048]) for i in range(0, len(index), 2048)])
            if epoch < epochs // 3:  # little learned yet: the windows with the worst words
                worst = x[:, 0] + x[:, DIM]
                logit = np.concatenate([worst, [-9]])[index].max(axis=1)
            order = np.lexsort((-logit, text))
            place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            bad = y[text[order]] > 0
            take = order[np.where(bad, place < 1, (place < 2) | (g.random(len(order)) < 0.02))]
            g.shuffle(take)
            label = y[text[take]]
            for i in range(0, len(take), BATCH):
                rows = take[i : i + BATCH]
                target = label[i : i + BATCH]
                grad = self.gradients(words, index[rows], target, np.ones(len(rows), np.float32))
                step += 1
                lr = rate * (1 if epoch < epochs // 2 else 0.3)
                for k, d in grad.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)

    @staticmethod
    def _grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(n), words.count)
        size = np.diff(words.offset)[words.of]
        cuts = np.cumsum(size) - size
        return words.grams[np.repeat(words.offset[words.of] - cuts, size) + np.arange(size.sum())], np.repeat(row, size)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores from 0 to 1 of whole texts."""
        out = np.full(len(texts), self.base)
        words = Words(texts)
        index, text = words.windows()
        if len(index):
            x, _ = self.inputs(words)
            logit = np.concatenate([self.forward(x, index[i : i + 2048]) for i in range(0, len(index), 2048)])
            starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[starts]] = _sigmoid(np.maximum.reduceat(logit, starts).astype(np.float64))
        return out


def train(documents: DataFrame, labels: DataFrame, fold: int = 5) -> Network:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    kept = labels.filter((F.crc32(F.col("doc_id").cast("string")) % fold != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in kept.groupBy("toxic").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, F.lit(1.05 * TRAIN_DOCS / max(1, sizes.get(1, 1)))).otherwise(F.lit(1.05 * TRAIN_DOCS / max(1, sizes.get(0, 1))))
    chosen = kept.filter(draw < share)  # at most about 2 * TRAIN_DOCS rows, a few bytes each
    rows = (
        documents.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).collect()  # the last text of an id, a row an id
    )
    rows.sort(key=lambda r: r["doc_id"])
    net = Network()
    net.fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows]))
    return net


def score_documents(documents: DataFrame, network: Network) -> DataFrame:
    """doc_id, score of every whole text."""
    from .tokens import in_batches

    # plain arrays of fixed size, 1 MB: executors need no copy of the package to read them
    sent = documents.sparkSession.sparkContext.broadcast((network.base, network.p))

    def score(batches):
        import pyarrow as pa

        net = Network()
        net.base, net.p = sent.value
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in in_batches(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(net.score(texts[a:b]))], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
