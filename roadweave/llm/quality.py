"""Document quality: a linear-chain conditional random field over lines, its marginals weighed by line length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LETTER, NUMBER, SPACE, bounded_batches, codepoint_classes, codepoints, text_slices

#: Labelled texts learned from at most (by the ids' hash), and lines of each (one run of lines of a longer text, by the same hash).
TRAIN_DOCS, TRAIN_LINES = 6000, 64
#: A score from here on is predicted good.
THRESHOLD = 0.7
#: Fixed classes of marks: those of prose, of mark-up and tables, and of shouting.
PROSE, MARKS, SHOUT = ".,;:?'\"()-", "#$%&*|<>{}[]=_~^\\/@+`", "!"
N_FEATURES = 20


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of numbers for each line, each line's length, and the row at which each text starts (an empty text has one line)."""
    lines = [t.split("\n") for t in texts]
    first = np.cumsum([0, *(len(x) for x in lines[:-1])])
    joined = "\n".join(texts) + "\n"
    cp = codepoints(joined)
    kind = codepoint_classes()[cp]
    stop = np.flatnonzero(cp == 10)
    start = np.append(0, stop[:-1] + 1)
    size = stop - start

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[stop] - total[start]).astype(float)

    table = np.zeros(128, np.uint8)
    for code, marks in enumerate((PROSE, MARKS, SHOUT), 1):
        table[[ord(c) for c in marks]] = code
    mark = np.where(cp < 128, table[np.minimum(cp, 127)], 0)
    letter, space = kind == LETTER, kind == SPACE
    upper = ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7))
    begins = ~space & np.append(True, space[:-1])
    after = np.append(False, letter[:-1])
    same = np.append(False, (cp[1:] == cp[:-1]) & ~space[1:])
    words, n = per_line(begins), np.maximum(size, 1)
    letters = per_line(letter)
    marks = per_line(mark == 2)
    ends = cp[np.maximum(stop - 1, 0)]
    strip = joined.split("\n")[:-1]
    seen: set[tuple[int, str]] = set()
    repeat = np.zeros(len(size))
    which = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    for i, key in enumerate(zip(which.tolist(), strip, strict=True)):
        repeat[i] = key in seen
        seen.add(key)
    x = np.stack(
        [
            np.log1p(size), letters / n, per_line(upper) / np.maximum(letters, 1), per_line(kind == NUMBER) / n, per_line(mark == 1) / n,
            marks / n, per_line(mark == 3) / n, marks / np.maximum(words, 1), per_line(same) / n, per_line((mark > 1) & after) / np.maximum(words, 1),
            letters / np.maximum(words, 1) / 8, np.log1p(words), per_line(begins & upper) / np.maximum(words, 1), np.isin(ends, [ord(c) for c in ".!?"]) & (size > 0),
            repeat, size == 0, words <= 3, per_line(~letter & ~space & (mark == 0) & (kind != NUMBER)) / n, per_line(letter & (cp > 127)) / n, marks > 0,
        ],
        axis=1,
    ).astype(np.float32)
    return x, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's numbers, those of the line before and of the line after (zero beyond the text), and a one."""
    n, stop = len(x), np.append(first[1:], len(x))
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[first < n]] = 0
    after[stop[stop > 0] - 1] = 0
    return np.concatenate([x, before, after, np.ones((n, 1), x.dtype)], axis=1)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def forward_backward(emit: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (sequences, lines, 2), summed pair marginals (sequences, 2, 2) and log normalisers of padded sequences."""
    m, t, _ = emit.shape
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for k in range(1, t):
        new = _lse(alpha[:, k - 1, :, None] + move, 1) + emit[:, k]
        alpha[:, k] = np.where((k < length)[:, None], new, alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        new = _lse(move + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where((k + 1 < length)[:, None], new, 0)
    z = _lse(alpha[:, -1], 1)
    gamma = np.exp(alpha + beta - z[:, None, None])
    gamma[np.arange(t)[None, :] >= length[:, None]] = 0
    pairs = np.zeros((m, 2, 2))
    for k in range(1, t):
        p = np.exp(alpha[:, k - 1, :, None] + move + (emit[:, k] + beta[:, k])[:, None, :] - z[:, None, None])
        pairs += np.where((k < length)[:, None, None], p, 0)
    return gamma, pairs, z


def _padded(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = np.minimum(first[:, None] + np.arange(int(length.max()))[None, :], len(values) - 1)
    return values[at]


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability that each line is good; texts of like numbers of lines run side by side."""
        energy = with_neighbours(self._standard(x), first) @ self.weights
        length = np.diff(np.append(first, len(x)))
        out = np.empty(len(x))
        size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for s in np.unique(size):
            rows = np.flatnonzero(size == s)
            e = _padded(energy, first[rows], length[rows])
            gamma, _, _ = forward_backward(np.stack([np.zeros_like(e), e], axis=2), length[rows], self.move)
            for r, g in zip(rows.tolist(), gamma[:, :, 1], strict=True):
                out[first[r] : first[r] + length[r]] = g[: length[r]]
        return out

    def raw(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's marginals, weighed by the lengths of its lines."""
        weight = size + 1.0
        return np.add.reduceat(self.marginals(x, first) * weight, first) / np.add.reduceat(weight, first)

    def scores(self, texts: list[str]) -> np.ndarray:
        x, size, first = line_features(texts)
        p = np.clip(self.raw(x, size, first), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.08, ridge: float = 1e-3) -> Crf:
    """Lines take their text's label; the likelihood of label sequences is climbed by Adam; then the texts' scores are calibrated on their labels."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = Crf(mean, scale, np.zeros(3 * x.shape[1] + 1), np.zeros((2, 2)))
    f = with_neighbours(model._standard(x), first)
    length = np.diff(np.append(first, len(x)))
    line_label = np.repeat(label, length)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    mask = np.arange(int(length.max()))[None, :] < length[:, None]
    theta = np.zeros(f.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        energy = _padded(f @ theta[:-4], first, length)
        gamma, pairs, _ = forward_backward(np.stack([np.zeros_like(energy), energy], axis=2), length, theta[-4:].reshape(2, 2))
        per_line = np.repeat(weight / length, length)
        grad = np.empty_like(theta)
        grad[:-4] = f.T @ ((line_label - gamma[:, :, 1][mask]) * per_line) - ridge * theta[:-4]
        same = np.zeros((len(label), 2, 2))
        same[np.arange(len(label)), label, label] = length - 1
        grad[-4:] = (((same - pairs) * (weight / length)[:, None, None]).sum(axis=0)).ravel() - ridge * theta[-4:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.move = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    p = np.clip(model.raw(x, size, first), 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps of a two-parameter logistic regression
        s = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = label - s, s * (1 - s) + 1e-9
        g = np.array([(r * z).sum() - 0.1 * (a - 1), r.sum() - 0.1 * b])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        da, db = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + da, b + db
    model.slope, model.shift = max(0.05, float(a)), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> Crf | None:
    """Learns from at most about ``max_docs`` labelled texts and ``max_lines`` consecutive lines of each; None if a label is missing.

    Labels other than 0 and 1 are left out, as are ids without text; an id labelled twice counts with its smaller label.
    The sample is bounded by these two parameters, whatever the input: the labels are sampled first and broadcast, so
    no text is shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("label") == 1, min(1.0, max_docs / 2 / sizes[1])).otherwise(min(1.0, max_docs / 2 / sizes[0]))
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for _, part in text_slices(batch.column(1)) for t in part]
            for i, text in enumerate(texts):
                x, size, _ = line_features([text])
                own = batch.column(0)[i].as_py()
                lo = (own if isinstance(own, int) else zlib.crc32(str(own).encode())) * 7919 % max(1, len(x) - max_lines + 1)
                part = slice(lo, lo + max_lines)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([x[part].tobytes()]), pa.array([size[part].tolist()])], names=["id", "label", "x", "size"])

    got = rows.select("id", "text", "label").mapInArrow(features, f"id {rows.schema['id'].dataType.simpleString()}, label int, x binary, size array<long>").toPandas()
    if got["label"].nunique() < 2:
        return None
    got = got.sort_values("id")
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]).astype(float)
    length = [len(s) for s in got["size"]]
    return fit(x, np.concatenate(got["size"].tolist()), np.cumsum([0, *length[:-1]]), got["label"].to_numpy())


def score(df: DataFrame, model: Crf | None, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, then score double (0 to 1, higher: more likely good).

    Null texts are empty, and an empty text is one empty line; whole texts count. Without a model every score is 0.5.
    Repeated rows give repeated rows; an empty table gives none; a clashing column named score is replaced.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    df = df.drop("score")
    if model is None:
        return df.withColumn("score", F.lit(0.5))
    shared = spark.sparkContext.broadcast(model)  # a few hundred numbers
    at, names = df.columns.index(text_col), df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores([t.decode("utf-8", "replace") for t in texts]) for _, texts in text_slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())], names=[*names, "score"])

    return df.mapInArrow(run, f"{kinds}, score double")
