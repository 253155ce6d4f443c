"""Language identification by a byte convolutional network, trained and applied in numpy.

Windows of a fixed number of bytes go through filters of several widths over bytes, max pooling and a softmax layer. A
filter's response at a place is a sum of one weight for each byte, so applying the network needs table look-ups, not
products. A text is cut into windows from its first byte to its last; its score is the mean of their probabilities,
weighted by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, unused


#: Bytes in a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Labelled documents the network is fitted on at most (those of the smallest id hashes), and passages from each.
TRAIN_DOCS, PASSAGES, PASSAGE = 6_000, 3, 200
UNKNOWN = "und"


@dataclass
class Net:
    langs: list[str]
    taps: list[np.ndarray]  # for each width: (width, 256, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """Look-ups (offset, bytes, table) of each width, two bytes at once where possible."""
        made = []
        for t in self.taps:
            own = [(j, 2, (t[j][:, None] + t[j + 1][None]).reshape(65_536, -1)) for j in range(0, len(t) - 1, 2)]
            made.append(own + [(len(t) - 1, 1, t[-1])] * (len(t) % 2))
        return made

    def probabilities(self, windows: np.ndarray, tables=None) -> np.ndarray:
        """Softmax over the languages for each window (rows of WINDOW bytes, zeros after the text)."""
        tables, found = tables or self.tables(), []
        for i in range(0, len(windows), 64):
            x = np.ascontiguousarray(windows[i : i + 64].T).astype(np.int32)  # place by window: pooling runs along contiguous rows
            pair = x[:-1] * 256 + x[1:]
            pooled = []
            for width, own in zip(WIDTHS, tables):
                n = WINDOW - width + 1
                act = sum(t[(pair if b == 2 else x)[o : o + n]] for o, b, t in own)
                pooled.append(act.max(0))
            found.append(self._softmax(np.maximum(np.concatenate(pooled, 1) + self.bias, 0)))
        return np.concatenate(found) if found else np.empty((0, len(self.langs)))

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.out + self.out_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    n = -(-len(raw) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x.reshape(n, WINDOW)


def train(passages: list[bytes], langs: list[str], rounds: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Net:
    """Fits the network on labelled passages by Adam; passages are cut short at random, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y_all = np.array([names.index(x) for x in langs])
    x_all = np.stack([windows_of(p[:WINDOW].ljust(1, b"\0"))[0] for p in passages])
    f = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS] + [
        np.zeros(f, np.float32), rng.normal(0, 0.2, (f, len(names))).astype(np.float32), np.zeros(len(names), np.float32),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(x_all))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            keep = rng.integers(12, WINDOW + 1, len(pick))
            x, y, at = np.where(np.arange(WINDOW) < keep[:, None], x_all[pick], 0), y_all[pick], np.arange(len(pick))
            pooled, best = [], []
            for w, t in zip(WIDTHS, params):
                n = WINDOW - w + 1
                act = sum(t[j][x[:, j : j + n]] for j in range(w))
                best.append(act.argmax(1))
                pooled.append(np.take_along_axis(act, best[-1][:, None], 1)[:, 0])
            pre = np.concatenate(pooled, 1) + params[-3]
            h = np.maximum(pre, 0)
            net = Net(names, params[: len(WIDTHS)], *params[-3:])
            dz = net._softmax(h)
            dz[at, y] -= 1
            dz /= len(pick)
            dh = (dz @ params[-2].T) * (pre > 0)
            grads = []
            for i, (w, t) in enumerate(zip(WIDTHS, params)):
                g, own = np.zeros_like(t), dh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (x[at[:, None], best[i] + j], np.arange(FILTERS)[None]), own)
                grads.append(g)
            grads += [dh.sum(0), h.T @ dz, dz.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Net(names, params[: len(WIDTHS)], *params[-3:])


def held_out(key: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text is divisible by 5 (a null id hashes as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Net | None:
    """The network, from at most ``most`` documents with a language and a letter that are not held out; None without any."""
    text, i = F.col(text_col), F.col(id_col)
    known, h = docs.where(F.col(lang_col).isNotNull() & ~held_out(i)), F.xxhash64(i)
    known = sampled(known, h, known.count(), most).where(has_letter(text))
    # short passages from anywhere in the text, cut before anything is collected
    cuts = [
        F.substring(
            text, (F.pmod(F.xxhash64(i, F.lit(p)), F.greatest(F.length(text) - PASSAGE, F.lit(1)).cast("long")) + 1).cast("int"),
            F.lit(PASSAGE),
        ) for p in range(PASSAGES)
    ]
    rows = known.select(
        h.alias("h"), F.col(lang_col).alias("lang"), *[c.alias(f"p{n}") for n, c in enumerate(cuts)],
    ).orderBy("h", "p0").limit(most).collect()
    pairs = [(r[f"p{n}"].encode(), r["lang"]) for r in rows for n in range(PASSAGES) if r[f"p{n}"].strip()]
    return train(*zip(*pairs)) if pairs else None


def identify(docs: DataFrame, net: Net | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the language and its score in columns ``out``, for every whole text.

    Null, empty and other texts without a letter are ``und`` with score 0, and so is all without a network. Long texts
    are read window by window to the end; equal texts get equal results; rows may repeat; an empty table gives an empty
    result. Other columns pass through, whatever their names; columns named as ``out`` are replaced.
    """
    tables = net.tables() if net else None
    names = net.langs if net else []

    def predict(texts: list[str | None]) -> Iterator[tuple[str, float]]:
        held, counts = [], []

        def told() -> Iterator[tuple[str, float]]:
            p, w, at = net.probabilities(np.concatenate(held), tables), np.concatenate(counts), 0
            for c in counts:
                mean = (p[at : at + len(c)] * w[at : at + len(c), None]).sum(0) / c.sum()
                at += len(c)
                yield names[int(mean.argmax())], float(min(1.0, mean.max()))
            held.clear(), counts.clear()

        for t in texts:
            raw = (t or "\0").encode()
            held.append(windows_of(raw))
            c = np.full(len(held[-1]), WINDOW, np.float64)
            c[-1] = len(raw) - WINDOW * (len(c) - 1)
            counts.append(c)
            if sum(map(len, held)) > 4_096:
                yield from told()
        if held:
            yield from told()

    @F.pandas_udf("lang string, score double")
    def run(texts):
        import pandas as pd

        return pd.DataFrame(list(predict(list(texts))), columns=["lang", "score"])

    if net is None:
        return docs.withColumns({out[0]: F.lit(UNKNOWN), out[1]: F.lit(0.0)})
    text = F.col(f"`{text_col}`")
    (own,) = unused(docs.columns, "net")
    found, ok = F.col(own), has_letter(text)
    told = {out[0]: F.when(ok, found["lang"]).otherwise(UNKNOWN), out[1]: F.when(ok, found["score"]).otherwise(0.0)}
    return docs.withColumn(own, run(text)).withColumns(told).drop(own)
