"""Multilingual mixture inference.

After Lui, Lau and Baldwin, "Automatic Detection and Language Identification of
Multilingual Documents" (TACL 2014): a document is a mixture of languages. Each word's
likelihood in a language is that of its byte n-grams; expectation-maximisation
estimates the proportions, and the set of languages is chosen by likelihood less a
penalty for each language more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, parts_of

#: Labelled documents of each language that the n-gram counts are learned from: on
#: average so many, chosen by a hash of the id.
TRAIN_PER_LANGUAGE = 4000
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
SMOOTHING = 0.2
ROUNDS = 6
#: What each language of a set must bring in log-likelihood for each word of the document,
#: and at least half a log of the number of words in all. It alone decides on the set.
LEAST_SHARE = 0.03
STEP = 8 << 20
_LETTER = r"\p{L}"
#: Letters of scripts that put no spaces between words; each is a word.
_SPACELESS = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"


def _ngram_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and the index of each n-gram's word."""
    framed = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(framed.buffers()[1], np.int64)[framed.offset : framed.offset + len(framed) + 1]
    data = np.frombuffer(framed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    at = np.repeat(np.arange(len(words)), np.diff(offsets))
    code, buckets, owners = np.zeros(len(data), np.uint32), [], []
    for n in range(1, max(ORDERS) + 1):
        keep = len(data) - n + 1
        if keep <= 0:
            break
        code = (code[:keep] * np.uint32(257)) + data[n - 1 :]
        if n in ORDERS:
            inside = at[:keep] == at[n - 1 :]
            mixed = (code[inside] ^ np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)
            buckets.append((mixed >> np.uint32(32 - 15)).astype(np.int32))
            owners.append(at[:keep][inside])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, offsets of each text's codes)."""
    texts = pc.utf8_lower(texts)
    if pc.any(pc.match_substring_regex(texts, _SPACELESS)).as_py():
        texts = pc.replace_substring_regex(texts, f"({_SPACELESS})", r" \1 ")
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    flat = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


def _steps(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // STEP
    at = 0
    for n in np.unique(size, return_counts=True)[1]:
        yield texts.slice(at, int(n))
        at += int(n)


def _counter(languages: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            langs = b.column(0).to_numpy(zero_copy_only=False)
            for k, name in enumerate(languages):
                chosen = b.column(1).filter(pa.array(langs == name)).cast(pa.large_string())
                if not len(chosen):
                    continue
                for texts in _steps(chosen):
                    words, codes, _ = _words(texts)
                    buckets, owners = _ngram_buckets(words)
                    often = np.bincount(codes, minlength=len(words))
                    total[k] += np.bincount(buckets, often[owners], BUCKETS).astype(np.int64)
        k, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[k, bucket])], ["k", "bucket", "n"]
        )

    return count


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(n-gram | language) as an array (bucket, language).

    ``docs`` has doc_id, text and a lang that is used wherever it and text are not null.
    Of each language a bounded, hash-chosen sample is counted.
    """
    rows = docs.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().collect())  # one row a language
    languages = [name for name, _ in sizes]
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for name, n in sizes for x in (name, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < share[F.col("lang")]).select("lang", "text")
    counts = np.zeros((BUCKETS, len(languages)))
    # at most BUCKETS rows a language
    found = sample.mapInArrow(_counter(languages), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["bucket"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    counts += SMOOTHING
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _em(likely: np.ndarray, starts: np.ndarray, doc: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document over its words, and its log-likelihood. ``likely``
    is each word's likelihood by language, scaled so that its largest is 1."""
    n = np.diff(np.append(starts, len(doc)))[:, None]
    for _ in range(rounds):
        part = likely * theta[doc]
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        theta = np.add.reduceat(part, starts, axis=0) / n
    total = np.add.reduceat(np.log((likely * theta[doc]).sum(axis=1) + 1e-30), starts)
    return theta, total


def _likely(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """Each word's likelihood by language, scaled so that its largest is 1."""
    buckets, owners = _ngram_buckets(words)
    logs = np.stack([np.bincount(owners, table[buckets, k], len(words)) for k in range(table.shape[1])], axis=1) / len(ORDERS)
    return np.exp(logs - logs.max(axis=1, keepdims=True)).astype(np.float32)


def _cost(sizes: np.ndarray) -> np.ndarray:
    """What each language of a document's set must bring in log-likelihood."""
    return np.maximum(0.5 * np.log(sizes + 1.0), LEAST_SHARE * sizes)


def long_mixture(text: bytes, table: np.ndarray) -> np.ndarray:
    """mixtures() of one text that is read part by part in every round, so that memory is
    bounded whatever its length."""
    languages = table.shape[1]

    def run(theta: np.ndarray, rounds: int) -> tuple[np.ndarray, float, int]:
        for last in [*[False] * rounds, True]:
            parts, value, n = np.zeros(languages), 0.0, 0
            for chunk in parts_of(text, STEP):
                words, codes, _ = _words(pa.array([chunk.decode()], pa.large_string()))
                if not len(codes):
                    continue
                part = _likely(words, table) * theta.astype(np.float32)
                each, often = part.sum(axis=1, keepdims=True) + 1e-30, np.bincount(codes, minlength=len(words))
                parts += (part / each * often[:, None]).sum(axis=0)
                value, n = value + float((np.log(each[:, 0]) * often).sum()), n + len(codes)
            if not n:
                return np.zeros(languages), 0.0, 0
            if not last:
                theta = parts / n
        return theta, value, n

    theta, _, n = run(np.full(languages, 1 / max(1, languages)), ROUNDS) if languages else (np.zeros(0), 0.0, 0)
    if not n:
        return np.zeros(languages, np.float32)
    order, penalty = np.argsort(-theta, kind="stable"), float(_cost(np.array([n]))[0])
    best, best_value = np.zeros(languages), -np.inf
    for k in range(1, languages + 1):
        if best_value >= -k * penalty:  # no set of k languages has a likelihood above 1
            break
        begin = np.zeros(languages)
        begin[order[:k]] = theta[order[:k]] + 1e-6
        part, value, _ = run(begin / begin.sum(), ROUNDS if k > 1 else 0)
        if value - k * penalty > best_value:
            best, best_value = part, value - k * penalty
    return best.astype(np.float32)


def mixtures(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Proportions (text, language) of the chosen set; zero rows for texts without words."""
    words, codes, offsets = _words(texts)
    out = np.zeros((len(texts), table.shape[1]), np.float32)
    has = np.flatnonzero(np.diff(offsets))
    if not len(has) or not table.shape[1]:
        return out
    likely = _likely(words, table)[codes]
    sizes = np.diff(offsets)[has]
    starts = offsets[has]
    doc = np.repeat(np.arange(len(has)), sizes)
    languages = table.shape[1]
    theta, _ = _em(likely, starts, doc, np.full((len(has), languages), 1 / languages, np.float32), ROUNDS)
    order = np.argsort(-theta, axis=1, kind="stable")
    penalty = _cost(sizes)
    best, best_value = None, None
    for k in range(1, languages + 1):
        inside = np.zeros_like(theta)
        np.put_along_axis(inside, order[:, :k], 1.0, axis=1)
        if k == 1:
            part = inside
            value = np.add.reduceat(np.log((likely * part[doc]).sum(axis=1) + 1e-30), starts) - penalty
            best, best_value = part, value
            continue
        # no set of k languages has a likelihood above 1, as each word's largest is 1; where
        # even that would not pay its languages, it cannot win
        open_ = np.flatnonzero(best_value < -k * penalty)
        if not len(open_):
            break
        chosen = np.isin(doc, open_)
        sub_sizes = sizes[open_]
        sub_starts = np.cumsum(sub_sizes) - sub_sizes
        begin = theta[open_] * inside[open_] + 1e-6 * inside[open_]
        part, value = _em(likely[chosen], sub_starts, np.repeat(np.arange(len(open_)), sub_sizes), begin / begin.sum(axis=1, keepdims=True), ROUNDS)
        value -= k * penalty[open_]
        better = value > best_value[open_]
        best[open_[better]], best_value[open_[better]] = part[better], value[better]
    out[has] = best
    return out


def _mixed(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    long = pc.greater(pc.binary_length(texts), 2 * STEP).to_numpy(zero_copy_only=False)
    if not long.any():
        return mixtures(texts, table)
    out = mixtures(pc.if_else(pa.array(long), pa.scalar("", texts.type), texts), table)
    for k in np.flatnonzero(long):
        out[k] = long_mixture(texts[int(k)].as_buffer().to_pybytes(), table)
    return out


def _predictor(languages: list[str], table: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, "und"], object)
        for b in batches:
            texts = pc.fill_null(b.column(1), "").cast(pa.large_string())
            lettered = pc.match_substring_regex(texts, _LETTER).to_numpy(zero_copy_only=False)
            theta = np.concatenate([_mixed(t, table) for t in _steps(texts)]) if len(texts) else np.zeros((0, len(languages)))
            if not languages:
                theta, lettered = np.zeros((len(texts), 1)), np.zeros(len(texts), bool)
            pick = np.where(lettered, theta.argmax(axis=1), len(languages))
            score = np.where(lettered, np.clip(theta.max(axis=1), 0, 1), 0.0).astype(np.float64)
            rest = [
                {languages[k]: float(row[k]) for k in np.flatnonzero(row > 0)} if ok else {}
                for row, ok in zip(theta, lettered, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names[pick], pa.string()), pa.array(score), pa.array([list(r.items()) for r in rest], pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "proportions"],
            )

    return predict


def identify(docs: DataFrame, train_docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, proportions map) of each row of ``docs`` by its text.

    A null text, one without a letter, or no labelled document at all gives `und` with
    score 0 and no proportions. Ties go to the language first in the alphabet. Repeated
    rows come back as often; a very long text is read part by part; other columns are
    ignored; an empty table gives an empty result.
    """
    languages, table = train(train_docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_predictor(languages, table), "doc_id long, lang_pred string, score double, proportions map<string,double>")


def held_out(docs: DataFrame) -> DataFrame:
    """identify() with the documents whose crc32 of the id mod 3 is 1 held out."""
    fold = F.coalesce(F.pmod(id_crc32(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    found = identify(docs, docs.filter(~fold))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "proportions")
