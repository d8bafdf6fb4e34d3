"""Language identification with a bidirectional gated recurrent network over bytes.

Two GRUs read the UTF-8 bytes of a text forwards and backwards; a softmax over both states labels every position. The
network is trained in numpy by backpropagation through time on pieces of a bounded sample of labelled documents
(Settings.sample_rows and Settings.pieces_per_row name the bound). A text is read whole, in consecutive segments, and a
document's probabilities are the mean over all its positions.

Null texts and texts without a letter are `und` with score 0. Without labelled documents every text is. Repeated rows
get a result each; a null id is held out. Extra columns are not returned by predict(); accepted() returns all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filter_texts

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    #: Labelled documents in the sample, for each language; at most twice as many are taken.
    sample_rows: int = 1000
    pieces_per_row: int = 4
    piece: int = 64
    steps: int = 300
    batch: int = 128
    rate: float = 0.02
    seed: int = 7
    #: Bytes of a segment when texts are labelled, and segments that are read side by side.
    segment: int = 128
    lanes: int = 4096


class Network:
    """Weights: for each direction x[256, 3h] (a byte's share of update, reset and candidate), u[h, 3h], c[h] (bias
    inside the reset), and out[2h, k], bias[k]."""

    def __init__(self, labels: list[str], weights: dict[str, np.ndarray]):
        self.labels, self.w = labels, weights

    @classmethod
    def fresh(cls, labels: list[str], s: Settings) -> Network:
        rng, h = np.random.default_rng(s.seed), s.hidden
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))
            w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
            w[f"c{d}"] = np.zeros(h)
        w["out"], w["bias"] = rng.normal(0, 1 / np.sqrt(h), (2 * h, len(labels))), np.zeros(len(labels))
        return cls(labels, {k: v.astype(np.float32) for k, v in w.items()})

    def gate(self, x: np.ndarray, h: np.ndarray, d: str):
        """One step: (new state, update, reset, candidate, the candidate's recurrent part)."""
        n = h.shape[1]
        own = h @ self.w[f"u{d}"]
        gates = 0.5 * squash(x[:, : 2 * n] + own[:, : 2 * n]) + 0.5
        z, r = gates[:, :n], gates[:, n:]
        inner = own[:, 2 * n :] + self.w[f"c{d}"]
        g = squash(x[:, 2 * n :] + r * inner)
        return g + z * (h - g), z, r, g, inner

    def train(self, pieces: np.ndarray, truth: np.ndarray, s: Settings) -> None:
        """Adam on the mean cross-entropy of all positions; pieces: bytes [n, piece]."""
        rng = np.random.default_rng(s.seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, s.steps + 1):
            at = rng.integers(0, len(pieces), s.batch)
            rate = s.rate * (1 - 0.95 * step / s.steps)
            for k, g in self.gradients(pieces[at], truth[at], s.hidden).items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def gradients(self, x: np.ndarray, truth: np.ndarray, n: int) -> dict[str, np.ndarray]:
        b, length = x.shape
        order = {"f": range(length), "b": range(length - 1, -1, -1)}
        kept, state = {}, {}
        for d in "fb":
            h, kept[d], state[d] = np.zeros((b, n), np.float32), [None] * length, np.zeros((length, b, n), np.float32)
            for t in order[d]:
                new, *rest = self.gate(self.w[f"x{d}"][x[:, t]], h, d)
                kept[d][t] = (h, *rest)
                h = state[d][t] = new
        both = np.concatenate([state["f"], state["b"]], axis=2)
        p = softmax(both @ self.w["out"] + self.w["bias"])
        p[:, np.arange(b), truth] -= 1
        p /= b * length
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["out"] = np.einsum("tbi,tbk->ik", both, p)
        grads["bias"] = p.sum(axis=(0, 1))
        back = p @ self.w["out"].T
        for d, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            later = np.zeros((b, n), np.float32)
            for t in reversed(order[d]):
                dh = part[t] + later
                h, z, r, g, inner = kept[d][t]
                dg = dh * (1 - z) * (1 - np.abs(g)) ** 2
                dz = dh * (h - g) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dg * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                dx = np.concatenate([dz, dr, dg], axis=1)
                du = np.concatenate([dz, dr, dg * r], axis=1)
                np.add.at(grads[f"x{d}"], x[:, t], dx)
                grads[f"u{d}"] += h.T @ du
                grads[f"c{d}"] += (dg * r).sum(axis=0)
                later = dh * z + du @ self.w[f"u{d}"].T
        return grads

    def label(self, texts: list[bytes], s: Settings) -> np.ndarray:
        """Mean probabilities over all positions [texts, labels]; zeros for an empty text."""
        sums = np.zeros((len(texts), len(self.labels)))
        starts = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), s.segment)]
        # The longest first: at each step the lanes that are still inside their segment come first.
        starts.sort(key=lambda x: min(s.segment, len(texts[x[0]]) - x[1]), reverse=True)
        for at in range(0, len(starts), s.lanes):
            own = starts[at : at + s.lanes]
            sizes = np.array([min(s.segment, len(texts[i]) - b) for i, b in own])
            flat = b"".join([texts[i][b : b + s.segment].ljust(s.segment, b"\0") for i, b in own])
            lanes = np.frombuffer(flat, dtype=np.uint8).reshape(len(own), s.segment).T
            np.add.at(sums, [i for i, _ in own], self.segments(np.ascontiguousarray(lanes), sizes))
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]

    def segments(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Summed probabilities of lanes x [time, lane] whose sizes descend."""
        length, b = x.shape
        n, half = self.w["cf"].shape[0], self.w["out"].T.astype(np.float32)
        active = np.searchsorted(-sizes, -np.arange(length)).tolist()  # lanes with size > t
        backward = np.zeros((length, len(self.labels), b), np.float32)
        step, h = self.reader("b"), np.zeros((n, b), np.float32)
        for t in range(length - 1, -1, -1):
            if k := active[t]:
                step(x[t, :k], h[:, :k])
                np.matmul(half[:, n:], h[:, :k], out=backward[t, :, :k])
        step, h = self.reader("f"), np.zeros((n, b), np.float32)
        sums = np.zeros((len(self.labels), b), np.float32)
        for t in range(length):
            if k := active[t]:
                step(x[t, :k], h[:, :k])
                p = backward[t, :, :k]
                p += half[:, :n] @ h[:, :k]
                p += self.w["bias"][:, None]
                p -= p.max(axis=0)
                np.exp(p, out=p)
                p /= p.sum(axis=0)
                sums[:, :k] += p
        return sums.T

    def reader(self, d: str):
        """A step over lanes side by side (one column each), in place and for reading only."""
        n = self.w["cf"].shape[0]
        table, recur, bias = np.ascontiguousarray(self.w[f"x{d}"].T), np.ascontiguousarray(self.w[f"u{d}"].T), self.w[f"c{d}"][:, None]

        def step(x: np.ndarray, h: np.ndarray) -> None:
            own = recur @ h
            a = np.take(table, x.astype(np.intp), axis=1, mode="clip")
            gates = a[: 2 * n]
            gates += own[: 2 * n]
            size = np.abs(gates)
            size += 1
            gates /= size
            gates += 1
            gates *= 0.5
            z, r, g, inner = a[:n], a[n : 2 * n], a[2 * n :], own[2 * n :]
            inner += bias
            inner *= r
            g += inner
            size = np.abs(g)
            size += 1
            g /= size
            h -= g
            h *= z
            h += g

        return step


def squash(x: np.ndarray) -> np.ndarray:
    """The activation in place of tanh (several times faster): x / (1 + |x|), whose slope at y is (1 - |y|)^2."""
    return x / (1 + np.abs(x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(df: DataFrame, s: Settings, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """Labelled pieces of text: a hash of the id picks about sample_rows documents a language, whatever the size of the
    table, and each gives pieces_per_row pieces from evenly spread places of the whole text."""
    import pyarrow as pa

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, s.sample_rows / n))])
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def cut(batches):
        for batch in batches:
            langs, pieces = [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                data = text.encode()
                room = max(0, len(data) - s.piece)
                for at in sorted({room * i // max(1, s.pieces_per_row - 1) for i in range(s.pieces_per_row)}):
                    langs.append(lang)
                    pieces.append(data[at : at + s.piece])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], names=["lang", "piece"])

    got = picked.select("text", "lang").mapInArrow(cut, "lang string, piece binary").limit(2 * s.sample_rows * s.pieces_per_row * len(counts)).collect()
    return sorted((r.lang, bytes(r.piece)) for r in got)


def fit(df: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the labelled documents that are not held out; None if there are none."""
    pieces = sample(df, s, id_col, text_col, lang_col)
    if not pieces:
        return None
    labels = sorted({lang for lang, _ in pieces})
    network = Network.fresh(labels, s)
    by_label = [[p for lang, p in pieces if lang == label] for label in labels]
    most = max(map(len, by_label))
    even = [(k, own[i % len(own)]) for k, own in enumerate(by_label) for i in range(most)]  # every language alike often
    x = np.frombuffer(b"".join([p.ljust(s.piece, b" ") for _, p in even]), dtype=np.uint8).reshape(len(even), s.piece)
    network.train(x, np.array([k for k, _ in even]), s)
    return network


def has_letter(text: str | None) -> bool:
    """Whether a character has a letter category; digits in circles, fractions and Roman numerals have not."""
    return text is not None and any(map(str.isalpha, text))


def labelled(network: Network | None, s: Settings, texts: list[str | None]) -> list[tuple[str, float]]:
    if network is None:
        return [(UNDETERMINED, 0.0)] * len(texts)
    p = network.label([t.encode() if has_letter(t) else b"" for t in texts], s)
    best = p.argmax(axis=1)
    return [(network.labels[k], float(min(1.0, p[i, k]))) if p[i, k] > 0 else (UNDETERMINED, 0.0) for i, k in enumerate(best.tolist())]


def predict(df: DataFrame, network: Network | None, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) per row."""
    from tidemark.llm.common import map_texts

    def kernel():
        def run(texts):
            found = labelled(network, s, texts)
            return [[k for k, _ in found], [p for _, p in found]]

        return run

    out = map_texts(df, id_col, text_col, "lang_pred string, score double", kernel)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def accepted(df: DataFrame, network: Network | None, least: float = 0.35, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language is determined with at least this score."""
    return filter_texts(df, text_col, lambda: lambda texts: [k != UNDETERMINED and p >= least for k, p in labelled(network, s, texts)])
