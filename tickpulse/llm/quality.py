"""Document quality by a factorisation machine.

Inputs are hashed words, statistics of the text's structure and its size data.  A
document's score is the sigmoid of a bias, a linear part, and the interactions of
all pairs of its inputs by ``rank`` latent factors.  The pair sum needs one pass
over the inputs: half of (square of the sum minus sum of the squares) per factor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickpulse.llm import rolling
from tickpulse.llm.scratch import small_batches

_CHUNK = 1 << 20
_LETTER_UP = np.zeros(256, bool)
_LETTER_UP[65:91] = True
_LETTER = _LETTER_UP.copy()
_LETTER[97:123] = True
_LETTER[128:] = True  # bytes of other scripts count as letters
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
STRUCTURE = (
    "log_bytes", "log_words", "log_lines", "upper", "digits", "marks", "end_marks", "word_length", "long_words", "words_per_line",
    "distinct", "top_word", "repeated_next", "repeated_words", "marked_words", "capital_words", "bare_marks", "line_starts",
)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def features(texts: pa.Array, buckets: int):
    """Yields per slice of the texts: the structure matrix, and the hashed words as row starts, buckets and weights.

    A word's weight is ``1 + log(count)``, divided by the Euclidean norm of its text.  Texts without words have none.
    """
    data_all, offsets_all = rolling.utf8_buffer(texts)
    first, n = 0, len(offsets_all) - 1
    while first < n:
        last = min(max(int(np.searchsorted(offsets_all, offsets_all[first] + _CHUNK, side="left")), first + 1), n)
        data, offsets = data_all[offsets_all[first] : offsets_all[last]], offsets_all[first : last + 1] - offsets_all[first]
        rows = last - first
        low = rolling.lower_az(data)
        begin, end, row = rolling.word_spans(low, offsets)
        hashes = rolling.span_hashes(rolling.prefix_hashes(low), begin, end)
        words = np.bincount(row, minlength=rows).astype(float)
        size = np.maximum(np.diff(offsets), 1).astype(float)
        some = np.maximum(words, 1)
        letters = np.maximum(_per_text(_LETTER[data], offsets), 1)
        marks = ~(_LETTER[data] | _DIGIT[data] | rolling._SPACE[data])
        lines = 1 + _per_text(data == 10, offsets)
        length = (end - begin).astype(float)
        final = data[end - 1] if len(end) else np.empty(0, np.uint8)
        head = data[begin] if len(begin) else np.empty(0, np.uint8)
        total_marks = np.append(0, np.cumsum(marks))
        word_marks = total_marks[end] - total_marks[begin]
        of = lambda x: np.bincount(row, weights=x, minlength=rows)
        same_next = np.zeros(len(row), bool)
        same_next[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        # words of a text by count
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.empty(0, np.int64)
        count = np.diff(np.append(at, len(h))).astype(float)
        h, r = h[at], r[at]
        top = np.zeros(rows)
        np.maximum.at(top, r, count)
        again = np.bincount(r, weights=(count - 1), minlength=rows)
        line_no = np.searchsorted(np.flatnonzero(data == 10), begin)
        starts_line = np.ones(len(begin), bool)
        starts_line[1:] = (line_no[1:] != line_no[:-1]) | (row[1:] != row[:-1])
        structure = np.stack(
            [
                np.log1p(size), np.log1p(words), np.log1p(lines), _per_text(_LETTER_UP[data], offsets) / letters, _per_text(_DIGIT[data], offsets) / size,
                _per_text(marks, offsets) / size, of(np.isin(final, np.frombuffer(b".!?", np.uint8))) / some, of(length) / some, of(length > 14) / some,
                np.log1p(words / lines), np.bincount(r, minlength=rows) / some, top / some, of(same_next) / some, again / some,
                of((word_marks > 0) & (length - word_marks > 0) & (word_marks > 1)) / some, of(_LETTER_UP[head]) / some,
                of(word_marks == length) / some, of(starts_line) / some,
            ],
            axis=1,
        )
        weight = 1 + np.log(count)
        norm = np.sqrt(np.bincount(r, weights=weight * weight, minlength=rows))
        yield first, structure, np.searchsorted(r, np.arange(rows + 1)), (h % np.uint64(buckets)).astype(np.int64), weight / norm[r]
        first = last


@dataclass
class FactorisationMachine:
    """Bias, linear weights and factors; the structure inputs come after the hashed words and are standardised."""

    buckets: int
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, structure: np.ndarray, starts: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Probability of a good document per row, in time linear in the number of inputs."""
        x = np.clip((structure - self.mean) / self.scale, -6, 6)
        lin, fac = self.linear[self.buckets :], self.factors[self.buckets :]
        margin = self.bias + x @ lin
        sums, squares = x @ fac, (x * x) @ (fac * fac)
        rows = np.repeat(np.arange(len(x)), np.diff(starts))
        margin += np.bincount(rows, weights=self.linear[bucket] * weight, minlength=len(x))
        for f in range(self.factors.shape[1]):
            part = self.factors[bucket, f] * weight
            sums[:, f] += np.bincount(rows, weights=part, minlength=len(x))
            squares[:, f] += np.bincount(rows, weights=part * part, minlength=len(x))
        margin += 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit(structure, starts, bucket, weight, label, buckets: int, rank: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss over rows in the given order (shuffled by ``seed``); no rows give a score of 0.5 everywhere."""
    rng = np.random.default_rng(seed)
    d = structure.shape[1]
    mean = structure.mean(axis=0) if len(structure) else np.zeros(d)
    scale = structure.std(axis=0) if len(structure) else np.ones(d)
    model = FactorisationMachine(buckets, mean, np.where(scale > 1e-9, scale, 1.0), 0.0, np.zeros(buckets + d), rng.normal(0, 0.02, (buckets + d, rank)))
    if not len(structure):
        model.factors[:] = 0
        return model
    share = np.clip(label.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    x_all = np.clip((structure - model.mean) / model.scale, -6, 6)
    seen_b, seen_l, seen_f = 1e-3, np.full(buckets + d, 1e-3), np.full((buckets + d, rank), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            size = starts[pick + 1] - starts[pick]
            at = np.repeat(starts[pick] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            rows = np.append(np.repeat(np.arange(len(pick)), size), np.repeat(np.arange(len(pick)), d))
            which = np.append(bucket[at], np.tile(np.arange(buckets, buckets + d), len(pick)))
            value = np.append(weight[at], x_all[pick].ravel())
            part = model.factors[which] * value[:, None]
            sums = np.zeros((len(pick), rank))
            np.add.at(sums, rows, part)
            squares = np.bincount(rows, weights=(part * part).sum(axis=1), minlength=len(pick))
            margin = model.bias + np.bincount(rows, weights=model.linear[which] * value, minlength=len(pick)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label[pick]) / len(pick)
            touched, slot = np.unique(which, return_inverse=True)
            g_linear = np.bincount(slot, weights=error[rows] * value) + decay * model.linear[touched]
            g_factor = np.zeros((len(touched), rank))
            np.add.at(g_factor, slot, error[rows][:, None] * value[:, None] * (sums[rows] - part))
            g_factor += decay * model.factors[touched]
            seen_b += error.sum() ** 2
            seen_l[touched] += g_linear**2
            seen_f[touched] += g_factor**2
            model.bias -= rate * error.sum() / np.sqrt(seen_b)
            model.linear[touched] -= rate * g_linear / np.sqrt(seen_l[touched])
            model.factors[touched] -= rate * g_factor / np.sqrt(seen_f[touched])
    return model


def held_out(id_column: Column) -> Column:
    """Documents kept from learning: crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("long").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, buckets: int = 1 << 14, **options) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled documents that are not held out, chosen by a hash of the id.

    ``sample`` bounds what the driver learns from; a few thousand rows settle so few statistics.  Of several
    labels of one id the larger counts; rows with a null id or label are ignored.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("double").alias("label"))
        .where("l_id is not null and label is not null")
        .where(~held_out(F.col("l_id")))
        .groupBy("l_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "label")  # at most ``sample`` rows

    def extract(batches):
        for b in batches:
            for first, structure, starts, bucket, weight in features(b.column("text"), buckets):
                rows = len(structure)
                cut = lambda x: [x[s:e].tolist() for s, e in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, rows), b.column("label").slice(first, rows), pa.array(structure.tolist(), pa.list_(pa.float64())), pa.array(cut(bucket), pa.list_(pa.int32())), pa.array(cut(weight.astype(np.float32)), pa.list_(pa.float32()))],
                    names=["doc_id", "label", "structure", "bucket", "weight"],
                )

    rows = found.mapInArrow(extract, "doc_id long, label double, structure array<double>, bucket array<int>, weight array<float>").toArrow()
    if not rows.num_rows:
        return fit(np.empty((0, len(STRUCTURE))), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), buckets, **options)
    rows = rows.sort_by("doc_id").combine_chunks()
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = rows.column("bucket").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return fit(flat("structure").reshape(rows.num_rows, -1), np.append(0, np.cumsum(sizes)), flat("bucket").astype(np.int64), flat("weight").astype(float), rows.column("label").to_numpy(), buckets, **options)


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row: the probability of label 1, and 1 where it reaches ``threshold``.

    Null and empty texts are scored like any other, from their structure alone.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            parts = [model.score(*x[1:]) for x in features(b.column("text"), model.buckets)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([*parts, np.empty(0)]))], names=["doc_id", "score"])

    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are whatever their names and types, whose score reaches ``threshold``.

    Only the text goes to the Python worker, in small batches.  Null and empty texts are scored like any other, from their
    structure alone; repeated rows and equal texts get the same decision each.  Very long texts are scored whole.  An empty table
    stays empty.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        parts = [model.score(*x[1:]) for x in features(texts, model.buckets)]
        return pa.array(np.concatenate([*parts, np.empty(0)]) >= threshold)

    return docs.where(good(F.col(f"`{text_col}`").cast("string")))
