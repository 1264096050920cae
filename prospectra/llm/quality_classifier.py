"""Quality classifier: gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import id_crc32, parts_of, tidy

#: Labelled documents that the trees are fitted on: at most about so many, chosen by a
#: hash of the id.
TRAIN_ROWS = 20_000
#: A score from here on predicts label 1.
THRESHOLD = 0.3
STEP = 2 << 20

FEATURES = (
    "log_bytes log_words word_bytes word_bytes_sd longest_word upper digit punct symbol high space newline entropy"
    " distinct_words repeated_next top_word distinct_lines line_words upper_words symbol_words alpha_words stop_words"
).split()
#: Frequent short words of four languages (fixed values).
STOP = "the and of to in that is was for with der die und das ein nicht von mit la le les et de que une pour el los en y por un se"


def _class_table() -> np.ndarray:
    kind = np.full(256, 6)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b" \t\r\x0b\x0c", b"\n")):
        kind[list(chars)] = k
    kind[128:] = 5
    kind[list(b"abcdefghijklmnopqrstuvwxyz")] = 7
    return kind  # 6: other ASCII, such as symbols


def _word_kinds(words: pa.Array) -> dict[str, np.ndarray]:
    match = lambda rule: pc.match_substring_regex(words, rule).to_numpy(zero_copy_only=False)
    return {
        "upper_words": match(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"),
        "symbol_words": match(r"[#*$%&|<>@{}\[\]\\/=+~^_]|!!|\?\?"),
        "alpha_words": match(r"^\p{L}+[.,;:!?]?$"),
        "stop_words": np.isin(pc.utf8_lower(words).to_numpy(zero_copy_only=False).astype(str), STOP.split()),
    }


def long_features(text: bytes) -> np.ndarray:
    """features() of one text that is read part by part, so that memory is bounded by its
    distinct words and lines."""
    hist, vocabulary, times = np.zeros(256, np.int64), [], []
    again, last, lines, line, filled = 0, None, [], xxhash.xxh64(), False
    for part in parts_of(text, STEP):
        hist += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = pc.utf8_split_whitespace(pa.array([part.decode()], pa.large_string())).flatten()
        words = words.filter(pc.greater(pc.binary_length(words), 0))
        if len(words):
            codes = words.dictionary_encode()
            at = codes.indices.to_numpy()
            vocabulary.append(codes.dictionary)
            times.append(np.bincount(at, minlength=len(codes.dictionary)))
            again += int((at[1:] == at[:-1]).sum()) + (words[0].as_py() == last)
            last = words[-1].as_py()
        first, *rest = part.split(b"\n")
        line.update(first)
        filled = filled or bool(first)
        for x in rest:
            if filled:
                lines.append(line.intdigest())
            line, filled = xxhash.xxh64(x), bool(x)
    if filled:
        lines.append(line.intdigest())
    kinds = _class_table()
    size = max(1, int(hist.sum()))
    share = [hist[kinds == k].sum() / size for k in range(8)]
    p = hist[hist > 0] / size
    merged = pa.table({"w": pa.concat_arrays(vocabulary or [pa.array([], pa.large_string())]), "n": np.concatenate(times or [np.zeros(0, np.int64)])})
    merged = merged.group_by("w").aggregate([("n", "sum")])
    words, n = merged["w"].combine_chunks(), merged["n_sum"].to_numpy().astype(np.int64)
    length, count = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(float), int(n.sum())
    per = max(1, count)
    mean = (length * n).sum() / per
    found = {
        "log_bytes": np.log1p(hist.sum()), "upper": share[0], "digit": share[1], "punct": share[2], "space": share[3], "newline": share[4], "high": share[5], "symbol": share[6],
        "entropy": -(p * np.log2(p)).sum(), "log_words": np.log1p(count), "word_bytes": mean, "word_bytes_sd": np.sqrt(max(0.0, (length**2 * n).sum() / per - mean**2)),
        "longest_word": np.log1p(length.max(initial=0)), "distinct_words": len(words) / per, "top_word": n.max(initial=0) / per, "repeated_next": again / per,
        "distinct_lines": len(set(lines)) / max(1, len(lines)), "line_words": count / max(1, len(lines)), **{k: (v * n).sum() / per for k, v in _word_kinds(words).items()},
    }
    return np.array([found[name] for name in FEATURES])


def _features(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    put = lambda name, v: out.__setitem__((slice(None), FEATURES.index(name)), v)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(pa.py_buffer(b"".join(t.as_buffer() for t in texts)), np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = _class_table()
    by_kind = np.stack([hist[:, kinds == k].sum(axis=1) for k in range(8)], axis=1)
    share = by_kind / np.maximum(size, 1)[:, None]
    put("log_bytes", np.log1p(size))
    for k, name in ((0, "upper"), (1, "digit"), (2, "punct"), (3, "space"), (4, "newline"), (5, "high"), (6, "symbol")):
        put(name, share[:, k])
    p = hist / np.maximum(size, 1)[:, None]
    put("entropy", -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1))

    lists = pc.utf8_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    # a white-space split leaves an empty word at either end
    words = flat.dictionary_encode()
    codes, vocabulary = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    v = len(vocabulary)
    length = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    real = length[codes] > 0
    codes, owner = codes[real], owner[real]
    count = np.bincount(owner, minlength=n)
    per = np.maximum(count, 1)
    wl = length[codes]
    put("log_words", np.log1p(count))
    mean = np.bincount(owner, wl, n) / per
    put("word_bytes", mean)
    put("word_bytes_sd", np.sqrt(np.maximum(np.bincount(owner, wl.astype(float) ** 2, n) / per - mean**2, 0)))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, wl)
    put("longest_word", np.log1p(longest))
    for name, flag in _word_kinds(vocabulary).items():
        put(name, np.bincount(owner, flag[codes], n) / per)
    pairs, times = np.unique(owner * max(v, 1) + codes, return_counts=True)
    of = pairs // max(v, 1)
    put("distinct_words", np.bincount(of, minlength=n) / per)
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    put("top_word", top / per)
    again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    put("repeated_next", np.bincount(owner[1:][again], minlength=n) / per)

    lines = pc.split_pattern(texts, "\n")
    row = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line = lines.flatten().dictionary_encode()
    filled = pc.binary_length(line.dictionary).to_numpy(zero_copy_only=False)[line.indices.to_numpy(zero_copy_only=False)] > 0
    row, code = row[filled], line.indices.to_numpy(zero_copy_only=False).astype(np.int64)[filled]
    n_lines = np.bincount(row, minlength=n)
    kinds_of_line = np.unique(row * max(len(line.dictionary), 1) + code) // max(len(line.dictionary), 1)
    put("distinct_lines", np.bincount(kinds_of_line, minlength=n) / np.maximum(n_lines, 1))
    put("line_words", count / np.maximum(n_lines, 1))
    return out


def features(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES) statistics of whole texts; a null text counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(size > 2 * STEP).tolist()
    apart = [long_features(texts[k].as_buffer().to_pybytes()) for k in long]
    if long:
        texts = pc.if_else(pa.array(size <= 2 * STEP), texts, pa.scalar("", texts.type))
        size = np.where(size > 2 * STEP, 0, size)
    parts, at = [np.zeros((0, len(FEATURES)))], 0
    for k in np.unique(np.cumsum(size) // STEP, return_counts=True)[1]:
        parts.append(_features(texts.slice(at, int(k))))
        at += int(k)
    out = np.concatenate(parts)
    for k, row in zip(long, apart, strict=True):
        out[k] = row
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = pa.array(list(features(b.column(1))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0), rows], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> gbdt.Model:
    """Fit on the documents that have a 0/1 label. Ids labelled both ways are left out; of
    rows repeated with one id the first text in order counts, once."""
    known = (
        labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .filter(F.col("label") == F.col("_most")).select("doc_id", F.col("label").cast("int"))
    )
    size = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    known = known.filter(draw < min(1.0, rows / max(size, 1)))
    # about ``rows`` ids at most, 16 bytes each: texts need no shuffle to meet them
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    found = chosen.mapInArrow(tidy(_feature_rows), "label int, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = found["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    return gbdt.fit(x[order], y[order])


def _scorer(model: gbdt.Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(features(b.column(1))))], ["doc_id", "score"])

    return score


def scores(docs: DataFrame, model: gbdt.Model) -> DataFrame:
    """(doc_id, score) of each row; empty and null texts are scored as texts without
    words. Without any usable label all scores are the prior, 0.5."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_scorer(model)), "doc_id long, score double")


def fold(doc_id) -> F.Column:
    """True where the crc32 of the id mod 5 is 0: these labels are never learned from."""
    return F.coalesce(F.pmod(id_crc32(doc_id), F.lit(5)) == 0, F.lit(False))


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, by trees fitted on the other fold.

    Null and empty texts are scored as texts without words; rows repeated with one text
    have one score; a null id is not held out; a tie at THRESHOLD predicts 1. Without a
    usable label all scores are the prior. Other columns are ignored; an empty table
    gives an empty result.
    """
    model = train(docs, labels.filter(~fold(F.col("doc_id"))))
    return scores(docs, model).select(
        "doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def _keeper(model: gbdt.Model, text_at: int, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(text_at))) >= threshold))

    return keep


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged whatever
    their names; null texts are scored as empty ones, equal rows stay or go together."""
    model = train(docs, labels.filter(~fold(F.col("doc_id"))))
    return docs.mapInArrow(tidy(_keeper(model, docs.columns.index("text"), threshold)), docs.schema)
