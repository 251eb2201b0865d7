r"""Language of a text from a convolutional network over bytes.

Windows of fixed length cover the whole text. In each, filters of several widths run over byte
embeddings, every filter keeps its largest value, and a softmax layer gives the probabilities of
the languages; a text's are those of the mean of its windows' log-probabilities, weighted by
their bytes. The network is trained in numpy by gradient descent on labelled windows.

For prediction the filters' responses to pairs of bytes are tabulated once, which gives the same
sums as the products: a filter of width four is two pairs, one of width three a pair and a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Rolling, chunks, flat, mix

WINDOW = 256
#: Labelled rows that training uses at most, those with the smallest seeded hashes of their ids, and windows of these texts,
#: those with the smallest hashes of text and place.
SAMPLE, SAMPLE_WINDOWS = 6_000, 24_000
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8


def windows(data: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``window`` bytes padded with zeros, text of each, bytes in each); neighbours overlap by the widest filter less one."""
    step = window - max(WIDTHS) + 1
    size = np.diff(off)
    count = np.where(size > 0, np.maximum(1, -(-(size - (window - step)) // step)), 0)
    doc = np.repeat(np.arange(len(size)), count)
    start = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * step
    length = np.minimum(window, off[1:][doc] - start)
    padded = np.concatenate((data, np.zeros(window, np.uint8)))
    rows = padded[start[:, None] + np.arange(window)]
    rows[np.arange(window) >= length[:, None]] = 0
    return rows, doc, length


class Network:
    """Embedding, filters by width and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "b": np.zeros(len(WIDTHS) * FILTERS), "o": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(languages)))), "c": np.zeros(max(1, len(languages)))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS))

    def _forward(self, rows: np.ndarray) -> tuple:
        x = self.p["e"][rows]
        best, where = [], []
        for w in WIDTHS:
            n = rows.shape[1] - w + 1
            r = sum(x[:, i : i + n] @ self.p[f"w{w}"][i] for i in range(w))
            at = r.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0])
        pooled = np.concatenate(best, axis=1) + self.p["b"]
        hidden = np.maximum(pooled, 0)
        return x, where, pooled, hidden, hidden @ self.p["o"] + self.p["c"]

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.005) -> None:
        """Adam on the cross-entropy of windows."""
        rng = np.random.default_rng(9)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                take = order[lo : lo + batch]
                r, y = rows[take], labels[take]
                x, where, pooled, hidden, out = self._forward(r)
                prob = np.exp(out - out.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                prob[np.arange(len(y)), y] -= 1
                prob /= len(y)
                g = {"o": hidden.T @ prob, "c": prob.sum(axis=0)}
                back = (prob @ self.p["o"].T) * (pooled > 0)
                g["b"] = back.sum(axis=0)
                ge = np.zeros((256, EMBEDDING))
                for k, w in enumerate(WIDTHS):
                    b, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[k]
                    gw = np.zeros_like(self.p[f"w{w}"])
                    lines = np.arange(len(y))[:, None]
                    for i in range(w):
                        code = r[lines, at + i]
                        gw[i] = np.einsum("nf,nfe->ef", b, self.p["e"][code])
                        np.add.at(ge, code.ravel(), (b[:, :, None] * self.p[f"w{w}"][i].T[None]).reshape(-1, EMBEDDING))
                    g[f"w{w}"] = gw
                g["e"] = ge
                t += 1
                for k, v in g.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.001 * (v * v - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> dict:
        """What prediction needs, in single precision."""
        byte = {(w, i): self.p["e"] @ self.p[f"w{w}"][i] for w in WIDTHS for i in range(w)}
        pair = lambda w, i: (byte[w, i][:, None] + byte[w, i + 1][None]).reshape(65536, FILTERS)
        left = np.concatenate([pair(w, 0) for w in (2, 3, 4)], axis=1).astype(np.float32)
        return {"left": left, "one": byte[3, 2].astype(np.float32), "right": pair(4, 2).astype(np.float32), **{k: self.p[k].astype(np.float32) for k in "boc"}}


def log_probabilities(t: dict, rows: np.ndarray) -> np.ndarray:
    """Of the languages, for each window."""
    out = np.zeros((len(rows), t["o"].shape[1]), np.float32)
    f = FILTERS
    for lo in range(0, len(rows), 512):
        r = rows[lo : lo + 512].astype(np.int32)
        pairs = r[:, :-1] * 256 + r[:, 1:]
        left = t["left"][pairs]
        two = left[:, :, :f].max(axis=1)
        three = (left[:, :-1, f : 2 * f] + t["one"][r[:, 2:]]).max(axis=1)
        four = (left[:, :-2, 2 * f :] + t["right"][pairs[:, 2:]]).max(axis=1)
        hidden = np.maximum(np.concatenate((two, three, four), axis=1) + t["b"], 0)
        raw = hidden @ t["o"] + t["c"]
        raw -= raw.max(axis=1, keepdims=True)
        out[lo : lo + 512] = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
    return out


def held_out(doc_id: str) -> Column:
    """Rows that no training may see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 3 = 1"), F.lit(False))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the texts with its language and a hash that orders the sample."""
    for batch in batches:
        lang = batch.column(0)
        for lo, hi, data, off in chunks(batch.column(1)):
            rows, doc, _ = windows(data, off)
            text = Rolling(data)(off[:-1], off[1:])
            first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
            place = np.arange(len(doc)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(doc))))
            key = mix(text[doc] + mix(place.astype(np.uint64) + np.uint64(1))) >> np.uint64(1)
            for a in range(0, len(rows), 4096):
                cut = rows[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 4096].view(np.int64)), lang.take(pa.array(doc[a : a + 4096] + lo)), pa.array([r.tobytes() for r in cut], pa.binary())], ["h", "lang", "window"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_windows: int = SAMPLE_WINDOWS) -> Network:
    """Train on windows of at most ``sample`` texts with a language and a letter, none of them held out.

    All windows of these whole texts are candidates; beyond ``sample_windows`` those with the smallest hashes are
    taken, wherever they are in a text. Of an id that comes more than once one text is taken.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter("doc_id is not null and lang is not null").filter(~held_out("doc_id")).filter(F.col("text").rlike(r"\p{L}"))
    # Ids first: texts do not move before the rows are known.
    chosen = known.groupBy("doc_id").agg(F.min(F.xxhash64("text", "lang")).alias("one")).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(sample)
    known = known.withColumn("one", F.xxhash64("text", "lang")).join(F.broadcast(chosen), ["doc_id", "one"]).dropDuplicates(["doc_id"])
    rows = known.select("lang", "text").mapInArrow(_window_rows, "h long, lang string, window binary").orderBy("h", "window", "lang").limit(sample_windows).toArrow().combine_chunks()
    languages = sorted(set(rows.column("lang").to_pylist()))
    net = Network(languages)
    if languages:
        cut = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        index = {x: i for i, x in enumerate(languages)}
        net.train(cut, np.array([index[x] for x in rows.column("lang").to_pylist()]))
    return net


def _rows(languages: list[str], tables: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, weight = np.zeros((n, len(languages))), np.zeros(n)
            data, off = flat(batch.column(2))
            # About a megabyte of windows at a time, also inside one long text.
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), side="right")) - 1)
                rows, doc, length = windows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                logs = log_probabilities(tables, rows) * length[:, None]
                for j in range(len(languages)):
                    total[lo:hi, j] = np.bincount(doc, weights=logs[:, j], minlength=hi - lo)
                weight[lo:hi] = np.bincount(doc, weights=length, minlength=hi - lo)
                lo = hi
            mean = total / np.maximum(weight, 1)[:, None]
            prob = np.exp(mean - mean.max(axis=1, keepdims=True)) if len(languages) else np.zeros((n, 1))
            prob /= np.maximum(prob.sum(axis=1, keepdims=True), 1e-300)
            use = batch.column(1).to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
            best = prob.argmax(axis=1)
            names = [languages[b] if u else "und" for b, u in zip(best, use, strict=True)]
            score = np.where(use, prob[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of whole texts: ``doc_id, held_out, lang_pred, score``, one row per input row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was
    learned. Equal texts get equal results; an id may be null; other columns are not read; an empty table
    gives an empty result. The tables that tasks get have a fixed size.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(text_col).alias("text"))
    out = docs.mapInArrow(_rows(net.languages, net.tables()), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
