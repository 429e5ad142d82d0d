"""Operator 13: quality of texts by a linear-chain conditional random field over their lines.

Every line is good or bad. What speaks for either are its own shape (letters, signs, repeats, length) and
that of the lines before and after it, each as one of a few steps; what ties neighbours together are the
chain's transitions. Forward and backward sums give each line's chance of being good, and a document's
score is the mean of these, weighted by the lines' lengths. The field is fitted to labels of documents,
each line of a document bearing its label: tasks give gradients of their rows, and only sums of the size
of the weights come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm.common import deleted, id_text, table, written

#: The steps of each measure of a line; a measure falls into the step of the first bound that it doesn't exceed.
STEPS = {
    "upper": (0.0, 0.1, 0.3, 0.6),  # capitals among letters
    "signs": (0.0, 0.02, 0.1, 0.25),  # signs that end no sentence, among bytes
    "marks": (0.0, 0.03, 0.1, 0.2),  # marks of sentences, among bytes
    "digits": (0.0, 0.05, 0.2, 0.5),
    "signed": (0.0, 0.1, 0.3, 0.6),  # words that end in a sign
    "lone": (0.0, 0.1, 0.3),  # signs that stand alone, among words
    "again": (0.0, 0.05, 0.15, 0.4),  # words that repeat the word before
    "distinct": (0.3, 0.5, 0.7, 0.85, 0.95),  # different words, among words
    "words": (1, 2, 4, 8, 16, 32, 64),
    "long": (2.0, 3.5, 5.0, 7.0, 10.0),  # mean bytes of a word
    "seen": (0.0,),  # whether the document has the line before
    "ended": (0.0,),  # whether a mark of sentences ends it
}
_FIRST = np.cumsum([0, *(len(s) + 1 for s in STEPS.values())])
#: Weights of a line's own steps, of those of the line before and after (the last of each: there is none).
SIZE = int(_FIRST[-1]) + 1
#: Bytes of text that are measured at once; a longer text goes alone and needs some fifty times its size.
SLICE_BYTES = 2_000_000

#: Kinds of bytes: 0 blank, 1 letter, 2 capital, 3 digit, 4 mark of sentences, 5 other sign, 6 a character's further bytes.
_KIND = np.full(256, 5, np.uint8)
_KIND[[*range(9, 14), 28, 29, 30, 31, 32]] = 0
_KIND[[*range(97, 123), *range(0xC0, 256)]] = 1
_KIND[65:91], _KIND[48:58], _KIND[0x80:0xC0] = 2, 3, 6
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_POWER = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


@dataclass
class Lines:
    """row: the text of each line that is not blank. steps: a row for each line. length: its characters."""

    row: np.ndarray
    steps: np.ndarray
    length: np.ndarray


def lines(texts: pa.StringArray) -> Lines:
    """The lines of texts (no nulls), in order, with their measures as steps."""
    n = len(texts)
    _, offsets, raw = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return Lines(np.zeros(0, np.int64), np.zeros((0, len(STEPS)), np.uint8), np.zeros(0, np.int64))
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([ends[full], breaks + 1]))
    row = np.repeat(full, np.bincount(np.searchsorted(ends[full + 1], breaks, "right"), minlength=len(full)) + 1)
    m = len(starts)
    of = np.repeat(np.arange(m, dtype=np.int32), np.diff(starts, append=len(data)))  # the line of each byte
    kind = _KIND[data]
    count = np.bincount(of * np.int32(8) + kind, minlength=m * 8).reshape(m, 8)
    solid = count[:, 1:7].sum(1)

    word = kind != 0
    before = np.concatenate([[False], word[:-1]])
    before[ends[full]] = False  # no word goes on into the next text
    first = np.flatnonzero(word & ~before)
    after = np.concatenate([~word[1:] | ~before[1:], [True]])
    last = np.flatnonzero(word & after)
    size, w_of = last - first + 1, of[first]
    at = np.flatnonzero(word)
    place = np.minimum(at - np.repeat(first, size), 255)
    hashes = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _POWER[place], np.concatenate([[0], np.cumsum(size)[:-1]])) if len(at) else np.zeros(0, np.uint64)
    n_words = np.bincount(w_of, minlength=m)
    per = lambda mask: np.bincount(w_of[mask], minlength=m)
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (w_of[1:] == w_of[:-1])

    keep = np.flatnonzero(n_words)
    some = np.maximum(n_words, 1)
    text_hash = np.zeros(m, np.uint64)
    if len(first):
        into = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        order = np.arange(len(first)) - np.repeat(into[keep], n_words[keep])
        text_hash[keep] = np.add.reduceat(hashes * _POWER[order % 256], into[keep])
    last_kind = np.zeros(m, np.uint8)
    last_kind[w_of] = kind[last]  # the last word's stays
    measures = {
        "upper": count[:, 2] / np.maximum(count[:, 1] + count[:, 2], 1),
        "signs": count[:, 5] / np.maximum(solid, 1),
        "marks": count[:, 4] / np.maximum(solid, 1),
        "digits": count[:, 3] / np.maximum(solid, 1),
        "signed": per(kind[last] == 5) / some,
        "lone": per((size == 1) & (kind[first] == 5)) / some,
        "again": per(again) / some,
        "distinct": per(_new(hashes, w_of)) / some,
        "words": n_words,
        "long": solid / some,
        "seen": np.zeros(m),
        "ended": last_kind == 4,
    }
    measures["seen"][keep] = ~_new(text_hash[keep], row[keep])
    steps = np.stack([np.searchsorted(np.array(bounds, float), measures[name][keep].astype(float), "left") for name, bounds in STEPS.items()], 1)
    return Lines(row[keep], steps.astype(np.uint8), (count.sum(1) - count[:, 6] - np.bincount(of[breaks], minlength=m))[keep])


def _new(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each hash is the first of its kind in its group."""
    import pandas as pd

    return ~pd.Series(hashes ^ (group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).duplicated().to_numpy()


@dataclass
class Field:
    """own, before, after: weights for good of the steps of a line and of its neighbours. step: transition[from, to],
    0 bad, 1 good. rest: the score of a text without lines."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray
    rest: float = 0.5

    @classmethod
    def of(cls, flat: np.ndarray, rest: float = 0.5) -> Field:
        return cls(*flat[: 3 * SIZE].reshape(3, SIZE), flat[3 * SIZE :].reshape(2, 2), rest)


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and count of lines of each text that has some, the longest first."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(first, append=len(row))
    order = np.argsort(-count, kind="stable")
    return first[order], count[order]


def _neighbours(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = row[1:] == row[:-1]
    return np.concatenate([[False], same]), np.concatenate([same, [False]])


def emissions(found: Lines, field: Field) -> np.ndarray:
    """How much each line's steps and those of its neighbours speak for good, against bad."""
    ids = found.steps + _FIRST[:-1]
    has_before, has_after = _neighbours(found.row)
    out = field.own[ids].sum(1) + field.own[-1]
    out += np.where(has_before, np.roll(field.before[ids].sum(1), 1), field.before[-1])
    return out + np.where(has_after, np.roll(field.after[ids].sum(1), -1), field.after[-1])


def marginals(emission: np.ndarray, first: np.ndarray, count: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's chance of being good, each chain's log sum over all labellings, and the expected transitions.

    Chains go side by side, one line of each at a time, the longest first."""
    a, b = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    alive = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")  # chains longer than t
    for t, k in enumerate(alive):
        at = first[:k] + t
        into = np.logaddexp(a[at - 1, 0, None] + step[0], a[at - 1, 1, None] + step[1]) if t else 0.0
        a[at] = into + np.stack([np.zeros(k), emission[at]], 1)
    moves = np.zeros((2, 2))
    end = first + count - 1
    total = np.logaddexp(a[end, 0], a[end, 1])
    for t in range(len(alive) - 2, -1, -1):
        k = alive[t + 1]
        at = first[:k] + t
        onward = b[at + 1] + np.stack([np.zeros(k), emission[at + 1]], 1)
        b[at] = np.logaddexp(step[:, 0] + onward[:, :1], step[:, 1] + onward[:, 1:])
        pair = a[at][:, :, None] + step[None] + onward[:, None, :] - total[:k, None, None]
        moves += np.exp(pair).sum(0)
    chance = np.exp(a[:, 1] + b[:, 1] - np.repeat(total, count)[np.argsort(np.repeat(first, count) + _within(count), kind="stable")])
    return chance, total, moves


def _within(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def loss(found: Lines, good: np.ndarray, field: Field) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the texts' labels (good by row), each for all lines of its text, and its gradient."""
    first, count = chains(found.row)
    e = emissions(found, field)
    chance, total, moves = marginals(e, first, count, field.step)
    y = good[found.row].astype(float)
    of_text = good[found.row[first]]
    seen = np.array([[(count[~of_text] - 1).sum(), 0], [0, (count[of_text] - 1).sum()]], float)
    value = total.sum() - (y * e).sum() - (seen * field.step).sum()
    ids, off = found.steps + _FIRST[:-1], chance - y
    has_before, has_after = _neighbours(found.row)
    parts = []
    for weight, none in ((off, off.sum()), (np.roll(np.where(has_before, off, 0), -1), off[~has_before].sum()), (np.roll(np.where(has_after, off, 0), 1), off[~has_after].sum())):
        part = np.bincount(ids.ravel(), np.repeat(weight, ids.shape[1]), minlength=SIZE)
        part[-1] = none
        parts.append(part)
    return value, np.concatenate([*parts, (moves - seen).ravel()])


def minimum(f, size: int, rounds: int, keep: int = 8) -> np.ndarray:
    """Where f (value and gradient) is least, by limited-memory quasi-Newton steps from zero that only go down."""
    x = np.zeros(size)
    value, slope = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, back = slope.copy(), []
        for s, y in reversed(pairs):
            back.append((s @ way) / (s @ y))
            way -= back[-1] * y
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), k in zip(pairs, reversed(back), strict=True):
            way += (k - (y @ way) / (s @ y)) * s
        reach = 1.0
        while True:
            new_value, new_slope = f(x - reach * way)
            if new_value <= value - 1e-4 * reach * (slope @ way) or reach < 1e-4:
                break
            reach /= 4
        s, y = -reach * way, new_slope - slope
        if new_value >= value:
            break
        done = value - new_value < 1e-4 * abs(value)
        x, value, slope = x + s, new_value, new_slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-keep:]
        if done:
            break
    return x


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.StringArray]]:
    texts = pc.fill_null(texts, "").cast(pa.string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def held_out(column: str):
    """Whether a doc_id is in the fold that no label is learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, rounds: int = 40, pull: float = 1.0) -> Field:
    """A field from at most ``most`` labelled documents outside the held-out fold (those with the least hashes).

    A document with several labels counts as good if any says so; null labels are left out. The steps of the
    sample's lines are a table; every round is one job over it, whose tasks send a gradient each. pull: how
    strongly weights are drawn to zero. Without labels all weights are zero, so every score is 0.5.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good is not null")
    y = y.where(~held_out("doc_id")).groupBy("doc_id").agg((F.max("good") > 0).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _slices(b.column(1)):
                found = lines(part)
                cut = np.searchsorted(found.row, np.arange(len(part) + 1))
                steps = [found.steps[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(steps, pa.binary())], ["good", "steps"])

    sample = id_text(docs).join(F.broadcast(y), "doc_id").repartition(12, "doc_id")  # at most `most` labels
    rows = written(sample.select("good", "text").mapInArrow(measure, "good boolean, steps binary"), "lines")
    total, good = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0))).first()

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        field = Field.of(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, slope = 0.0, np.zeros(len(flat))
            for b in batches:
                raw = b.column(1).to_pylist()
                steps = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, len(STEPS))
                if len(steps):
                    row = np.repeat(np.arange(len(raw)), [len(x) // len(STEPS) for x in raw])
                    v, g = loss(Lines(row, steps, np.ones(len(row), np.int64)), b.column(0).to_numpy(zero_copy_only=False).astype(bool), field)
                    total, slope = total + v, slope + g
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total]), pa.array([slope.tolist()], pa.list_(pa.float64()))], ["part", "value", "slope"])

        found = sorted(rows.mapInArrow(run, "part long, value double, slope array<double>").collect())  # twelve rows at most
        return sum(r["value"] for r in found) + pull / 2 * float(flat @ flat), np.sum([r["slope"] for r in found], 0) + pull * flat

    if not total:
        return Field.of(np.zeros(3 * SIZE + 4))
    field = Field.of(minimum(value, 3 * SIZE + 4, rounds), good / total)
    deleted(docs.sparkSession, rows)
    return field


def judged(texts: pa.Array, field: Field) -> tuple[Lines, np.ndarray]:
    """The lines of texts and each one's chance of being good."""
    found = lines(texts)
    return found, marginals(emissions(found, field), *chains(found.row), field.step)[0]


def judged_lines(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, line (1 for the first that is not blank), n_chars and good, the chance that it is good, of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _slices(b.column(1)):
                found, chance = judged(part, field)
                number = np.arange(len(found.row)) - np.searchsorted(found.row, found.row) + 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)).take(pa.array(found.row)), pa.array(number), pa.array(found.length), pa.array(chance)], ["doc_id", "line", "n_chars", "good"])

    return id_text(docs).mapInArrow(run, "doc_id long, line long, n_chars long, good double")


def scored(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) of each row, from its whole text alone.

    The score is the mean of the lines' chances of being good, weighted by their characters. Texts without
    lines (null, empty, blank) get the share of good documents in the sample. Repeated rows get equal
    scores. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _slices(b.column(1)):
                found, chance = judged(part, field)
                n = len(part)
                size = np.bincount(found.row, found.length, minlength=n)
                score = np.where(size > 0, np.bincount(found.row, chance * found.length, minlength=n) / np.maximum(size, 1), field.rest)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of documents. Null, empty and blank texts: the share of good documents in the sample. Null
    doc_id: scored, not held out. Very long texts: whole, in chains as long as their lines. Ties and repeated rows:
    equal scores. Other columns, clashing names among them, are ignored. Empty documents: empty result; without
    labels every score is 0.5."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
