"""Operator 8, language identification by a bidirectional gated recurrent network over bytes.

The network reads a document's UTF-8 bytes (lower case) in both directions, labels every byte, and the document pools the
probabilities of the bytes that belong to letters. Texts are read in windows of CORE bytes with CONTEXT more on either side:
the state starts at the window's end and has read the context before the first byte that it labels, so words and what stands
between them are read together and every byte is labelled once. In texts of one language the windows agree with one pass over
the whole text (tested to 0.01 of the probability); after long runs of another language, or of
signs that training never met, a window has forgotten them by its context, as a full pass may not. Training is numpy alone: backpropagation through time and Adam.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices

#: Bytes that a window labels, bytes read beside them on either side, windows computed at once.
CORE, CONTEXT, BATCH = 224, 16, 1024
#: Bytes of a training window.
TRAINED = 48


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


@functools.cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter (categories L*)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_bytes(text: str) -> np.ndarray:
    """For each byte of the text in UTF-8 whether it belongs to a letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.repeat(letter_table()[codes], 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))


def sequences(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time x batch bytes, lengths) of byte strings; padding is 0."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    out = np.zeros((len(runs), int(lengths.max())), np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
    return np.ascontiguousarray(out.T), lengths


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """One gated layer each way (gates z, r and candidate n side by side) and a softmax on both states at every position."""

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.w = {f"{d}{k}": draw(*shape) for d in "fb" for k, shape in (("x", (256, 3 * hidden)), ("u", (hidden, 3 * hidden)), ("c", (3 * hidden,)))}
        self.w |= {"o": draw(2 * hidden, len(labels)), "p": np.zeros(len(labels), np.float32)}

    def forward(self, x: np.ndarray, lengths: np.ndarray, way: str, keep: bool = False):
        """States (time, batch, hidden) of one direction; with keep also what the way back needs."""
        h = self.hidden
        inputs = self.w[way + "x"] + self.w[way + "c"]
        u = self.w[way + "u"]
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        state = np.zeros((x.shape[1], h), inputs.dtype)
        out, kept = np.empty((*x.shape, h), inputs.dtype), {}
        for t in steps:
            on = (lengths > t)[:, None]
            a, b = inputs[x[t]], state @ u
            zr = sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            new = np.where(on, n + z * (state - n), state)
            if keep:
                kept[t] = (state, z, r, n, b[:, 2 * h :], on)
            state = out[t] = new
        return out, kept

    def backward(self, x: np.ndarray, way: str, kept: dict, grads: np.ndarray, total: dict) -> None:
        """Adds to total the gradients of one direction from those of its states."""
        h, u = self.hidden, self.w[way + "u"]
        dx, du, dc = np.zeros_like(self.w[way + "x"]), np.zeros_like(u), np.zeros(3 * h, np.float32)
        carried = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x) - 1, -1, -1) if way == "f" else range(len(x)):
            state, z, r, n, bn, on = kept[t]
            d = carried + grads[t]
            live = d * on
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (state - n) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            inner = np.concatenate([dz, dr, dn * r], axis=1)
            du += state.T @ inner
            outer = np.concatenate([dz, dr, dn], axis=1)
            np.add.at(dx, x[t], outer)
            dc += outer.sum(axis=0)
            carried = d * ~on + live * z + inner @ u.T
        total[way + "x"], total[way + "u"], total[way + "c"] = dx, du, dc

    def states(self, x: np.ndarray, lengths: np.ndarray, way: str) -> np.ndarray:
        """forward() without what training needs, as (time, hidden, batch): gates in contiguous rows, computed in place.

        sigmoid(v) is (tanh(v / 2) + 1) / 2; the halves are multiplied into the weights beforehand.
        """
        h = self.hidden
        half = np.repeat(np.array([0.5, 0.5, 1.0], self.w["o"].dtype), h)[:, None]
        inputs = np.ascontiguousarray((self.w[way + "x"] + self.w[way + "c"]).T * half)
        u = np.ascontiguousarray(self.w[way + "u"].T) * self.w["o"].dtype.type(0.5)
        a, b = np.empty((3 * h, x.shape[1]), inputs.dtype), np.empty((3 * h, x.shape[1]), inputs.dtype)
        out = np.empty((len(x), h, x.shape[1]), inputs.dtype)
        state = np.zeros((h, x.shape[1]), inputs.dtype)
        shortest = int(lengths.min())
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            np.take(inputs, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=b)
            zr, n, bn = a[: 2 * h], a[2 * h :], b[2 * h :]
            zr += b[: 2 * h]
            np.tanh(zr, out=zr)
            zr += 1
            bn *= zr[h:]
            n += bn
            np.tanh(n, out=n)
            new = np.subtract(state, n, out=out[t])
            zr[:h] *= 0.5
            new *= zr[:h]
            new += n
            if t >= shortest:
                np.copyto(new, state, where=lengths <= t)
            state = new
        return out

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, label, batch); 0 beyond a string's end."""
        o = np.ascontiguousarray(self.w["o"].T)
        e = np.matmul(o[:, : self.hidden], self.states(x, lengths, "f"))
        e += np.matmul(o[:, self.hidden :], self.states(x, lengths, "b"))
        e += self.w["p"][:, None]
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        if len(x) > lengths.min():
            e *= (np.arange(len(x))[:, None] < lengths)[:, None, :]
        return e

    def pooled(self, text: str) -> list[tuple[bytes, np.ndarray]]:
        """The text's windows: bytes with context, and a weight of 1 for each byte that it labels and that belongs to a letter."""
        raw = text.encode("utf-8", "surrogatepass")
        letters = letter_bytes(text)
        out = []
        for at in range(0, len(raw), CORE):
            begin, end = max(0, at - CONTEXT), min(len(raw), at + CORE + CONTEXT)
            weight = np.zeros(end - begin, np.float32)
            weight[at - begin : at - begin + CORE] = letters[at : at + CORE]
            if weight[at - begin : min(at + CORE, len(raw)) - begin].any():  # else there is nothing to label
                weight[at - begin + CORE :] = 0
                out.append((raw[begin:end], weight))
        return out

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """For each text the sum of its letters' probabilities, and in the last column how many bytes of letters."""
        out = np.zeros((len(texts), len(self.labels) + 1))
        windows, of = [], []
        for k, text in enumerate(texts):
            found = self.pooled(text.lower()) if text else []
            windows += found
            of += [k] * len(found)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i][0]))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            x, lengths = sequences([windows[i][0] for i in part])
            weights = np.zeros((len(part), len(x)), np.float32)
            weights[np.arange(len(x)) < lengths[:, None]] = np.concatenate([windows[i][1] for i in part])
            p = self.probabilities(x, lengths)
            p *= weights.T[:, None, :]
            np.add.at(out, [of[i] for i in part], np.column_stack([p.sum(axis=0).T, weights.sum(axis=1)]))
        return out

    def train(self, texts: list[list[tuple[bytes, np.ndarray]]], steps: int = 260, batch: int = 160, rate: float = 0.02, seed: int = 6) -> None:
        """texts: for each label its texts' bytes with whether they belong to letters. A step draws equally from all labels, and from a text's bytes a window of TRAINED."""
        rng = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}
        for step in range(1, steps + 1):
            y = rng.integers(0, len(texts), batch)
            drawn = [texts[k][int(rng.integers(len(texts[k])))] for k in y.tolist()]
            places = [int(rng.integers(max(1, len(raw) - TRAINED + 1))) for raw, _ in drawn]
            x, lengths = sequences([raw[p : p + TRAINED] for (raw, _), p in zip(drawn, places, strict=True)])
            weights = np.zeros((batch, len(x)))
            weights[np.arange(len(x)) < lengths[:, None]] = np.concatenate([on[p : p + TRAINED] for (_, on), p in zip(drawn, places, strict=True)])
            total = self.gradients(x, lengths, y, weights.T)
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in total.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability of labels y over the positions of weight 1 (time x batch)."""
        f, kf = self.forward(x, lengths, "f", True)
        b, kb = self.forward(x, lengths, "b", True)
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.w["o"] + self.w["p"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(len(y)), y] -= 1
        d = (d * weights[:, :, None] / max(weights.sum(), 1.0)).astype(both.dtype)
        total = {"o": np.tensordot(both, d, ((0, 1), (0, 1))), "p": d.sum(axis=(0, 1))}
        back = d @ self.w["o"].T
        self.backward(x, "f", kf, back[:, :, : self.hidden], total)
        self.backward(x, "b", kb, back[:, :, self.hidden :], total)
        return total


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int, chars: int, most_languages: int) -> Network | None:
    """A network trained on the labelled rows that are not held out; None without any that holds a letter.

    About rows_per_language rows of a language, chosen by a hash of the id, give up to chars characters each from a hashed place: that
    bound is all that reaches the driver, besides one count per language, of which there may be most_languages.
    """
    fit = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    fit = fit.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out(F.col("id")), F.lit(False)))
    counts = {r["lang"]: r["count"] for r in fit.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages if the driver is to hold {rows_per_language} texts of each")
    if not counts:
        return None
    ticket = F.pmod(F.xxhash64("id", "text", F.lit("pick")), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (ticket < int(min(1.0, rows_per_language / n) * 1_000_000)))
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    rows = fit.where(chosen).select("id", "lang", F.substring("text", place.cast("int"), F.lit(chars)).alias("text")).collect()
    texts: dict[str, list[tuple[bytes, np.ndarray]]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["id"] or "", r["text"])):
        lower = r["text"].lower()
        if (on := letter_bytes(lower)).any():
            texts.setdefault(r["lang"], []).append((lower.encode(), on))
    if not texts:
        return None
    network = Network(sorted(texts))
    network.train([texts[lang] for lang in network.labels])
    return network


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 400, chars: int = 600, most_languages: int = 500) -> DataFrame:
    """One row per row of docs: the id, held_out, lang_pred and score (the pooled probability of lang_pred).

    Training reads a bounded sample: rows_per_language labelled texts, chars characters of each. The prediction reads the whole text
    and nothing else. Null texts and texts without a letter (category L) are `und` with score 0, as are all if nothing
    is labelled; null ids are not held out; repeated rows stay repeated; an empty table gives no rows; columns not named are
    not read, so names cannot clash.
    """
    spark = docs.sparkSession
    network = learn(docs, id_col, text_col, lang_col, rows_per_language, chars, most_languages)
    if network is None:
        plain = docs.select(docs[id_col], F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"))
        return plain.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(network)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 256):
            langs, scores = label(shared.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    base = docs.select(docs[id_col].alias("id"), F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return base.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def label(network: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Labels of texts and the share of the letters' bytes that speaks for them."""
    sums = network.documents(texts)
    best = sums[:, :-1].argmax(axis=1)
    share = sums[np.arange(len(texts)), best] / np.maximum(sums[:, -1], 1)
    some = sums[:, -1] > 0
    return [network.labels[k] if on else "und" for k, on in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, np.minimum(share, 1.0), 0.0).tolist()
