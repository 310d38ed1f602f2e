"""Language identification by a convolutional network over bytes, written and trained in numpy.

A text is cut into windows of ``window`` bytes, all of it. In a window, filters of several widths slide over the
bytes: a filter's response at a position is the sum of its weights for the bytes it covers; each filter's largest
response goes through a softmax layer. Windows of all texts of a batch run through the network together; a text's
prediction is the mean of its windows' probabilities, weighted by their lengths.

The network is trained on the driver on a bounded sample: at most ``per_lang`` distinct texts per language, from each
``windows_each`` windows at places that a hash picks from the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import text_or_empty
from framewise.session import cut_lineage

PAD = 256  # the symbol after the end of a short window


class ByteConvNet:
    """Multi-width byte filters, max pooling, softmax. ``tables[w][j]`` holds, for offset j of the filters of width
    w, a weight per byte and filter (a one-hot convolution is a lookup)."""

    def __init__(self, langs: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, window: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.widths, self.filters, self.window = langs, widths, filters, window
        self.tables = {w: rng.normal(0, 0.3, (w, 257, filters)).astype(np.float32) for w in widths}
        for t in self.tables.values():
            t[:, PAD] = 0
        self.out = rng.normal(0, 0.1, (filters * len(widths), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest response of every filter (n, widths x filters) and where it is."""
        best, where = [], {}
        for w in self.widths:
            n = x.shape[1] - w + 1
            r = self.tables[w][0][x[:, :n]]
            for j in range(1, w):
                r += self.tables[w][j][x[:, j:j + n]]
            where[w] = r.argmax(axis=1)
            best.append(np.take_along_axis(r, where[w][:, None, :], axis=1)[:, 0])
        return np.maximum(np.concatenate(best, axis=1), 0), where

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._scores(x) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        """Pooled responses without their places, two bytes per lookup."""
        if not hasattr(self, "_pairs"):
            self._pairs = {}
            for w, t in self.tables.items():
                self._pairs[w] = [(t[j][:, None] + t[j + 1][None, :]).reshape(-1, self.filters) if j + 1 < w else t[j]
                                  for j in range(0, w, 2)]
        pair = x[:, :-1] * 257 + x[:, 1:]
        best = []
        for w in self.widths:
            n = x.shape[1] - w + 1
            r = None
            for k, t in enumerate(self._pairs[w]):
                j = 2 * k
                got = t[(pair if j + 1 < w else x)[:, j:j + n]]
                r = got if r is None else np.add(r, got, out=r)
            best.append(r.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1), 0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross entropy. Only the places of the largest responses carry a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.out, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        f = np.arange(self.filters)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at:at + batch]
                xb, yb = x[rows], y[rows]
                h, where = self._pooled(xb)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                dh = (p @ self.out.T) * (h > 0)
                grads = []
                for i, w in enumerate(self.widths):
                    g = np.zeros_like(self.tables[w])
                    part = dh[:, i * self.filters:(i + 1) * self.filters]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, where[w] + j, axis=1), f[None, :]), part)
                    g[:, PAD] = 0
                    grads.append(g)
                grads += [h.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        self.__dict__.pop("_pairs", None)

    def windows(self, raw: bytes) -> np.ndarray:
        """All of a text in windows; the last one is padded."""
        n = max(1, -(-len(raw) // self.window))
        x = np.full(n * self.window, PAD, np.int32)
        x[:len(raw)] = np.frombuffer(raw, np.uint8)
        return x.reshape(n, self.window)

    def predict(self, texts: list[bytes], batch: int = 256) -> tuple[list[str], np.ndarray]:
        """Language and probability per text, ``batch`` windows at a time; memory does not grow with a text's
        length beyond its own bytes."""
        sums, weight = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held, owners, lengths = [], [], []
        waiting = 0

        def run() -> None:
            p = self.probabilities(np.concatenate(held))
            w = np.concatenate(lengths)
            np.add.at(sums, np.concatenate(owners), p * w[:, None])
            np.add.at(weight, np.concatenate(owners), w)
            held.clear(), owners.clear(), lengths.clear()

        for i, raw in enumerate(texts):
            for at in range(0, max(len(raw), 1), batch * self.window):
                piece = raw[at:at + batch * self.window]
                x = self.windows(piece)
                size = np.full(len(x), self.window, float)
                size[-1] = max(len(piece) - (len(x) - 1) * self.window, 1)
                held.append(x), owners.append(np.full(len(x), i)), lengths.append(size)
                waiting += len(x)
                if waiting >= batch:
                    run()
                    waiting = 0
        if held:
            run()
        p = sums / np.maximum(weight, 1)[:, None]
        best = p.argmax(axis=1)
        return [self.langs[b] for b in best], np.minimum(p[np.arange(len(texts)), best], 1.0)


def is_held_out(doc_id) -> "F.Column":
    """One in five documents, by crc32 of the id as text; they are never learned from."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800,
          windows_each: int = 2, **net) -> ByteConvNet | None:
    """A network trained on documents that are not held out and have a language and a letter; None if there are
    none. The sample: per language the ``per_lang`` distinct texts with the smallest hashes (a ranked filter before
    the shuffle, so a language with most of the rows is cut down where it is read)."""
    window = net.get("window", 256)
    ok = docs.where(~is_held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    keyed = ok.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    by = Window.partitionBy("lang").orderBy("h")
    chosen = cut_lineage(keyed.distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_lang).drop("r"))
    d = ok.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.encode(text_col, "utf-8").alias("b"))
    d = d.join(F.broadcast(chosen), ["lang", "h"])  # at most per_lang rows a language
    places = F.array(*[F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.octet_length("b") - window, F.lit(0)) + 1).cast("int")
                       for i in range(windows_each)])
    parts = d.groupBy("lang", "h").agg(F.first(F.transform(places, lambda p: F.substring(F.col("b"), p + 1, F.lit(window)))).alias("parts"))
    rows = parts.orderBy("lang", "h").toPandas()
    if rows.empty:
        return None
    langs = sorted(set(rows["lang"]))
    model = ByteConvNet(langs, **net)
    index = {c: i for i, c in enumerate(langs)}
    x = np.concatenate([model.windows(bytes(p))[:1] for ps in rows["parts"] for p in ps])
    y = np.array([index[c] for c, ps in zip(rows["lang"], rows["parts"]) for _ in ps])
    model.train(x, y)
    return model


def identify(docs: DataFrame, model: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` of every row. A null text, or one without a letter, is ``und`` with
    score 0; so is everything if there is no model. Whole texts, no shuffle."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("ok"),
                      is_held_out(F.col(id_col)).alias("held_out"), text_or_empty(F.col(text_col)).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for b in batches:
            lang, score = np.full(len(b), "und", object), np.zeros(len(b))
            ok = np.flatnonzero(b["ok"].to_numpy(bool)) if net else []
            if len(ok):
                names, p = net.predict([t.encode("utf-8", "surrogatepass") for t in b["t"].iloc[ok]])
                lang[ok], score[ok] = names, p
            yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "lang_pred": lang, "score": score})

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
