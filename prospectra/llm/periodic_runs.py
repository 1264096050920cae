"""Periodic runs of words, found in tiles of each octave of periods.

For periods from 2^k up to 2^(k+1) - 1 = P - 1 a document is cut into tiles around the
boundaries c = P, 2P, ...: the words from c - P up to c + 2P. Z-functions at a boundary
give, for each period p of the octave, how far to the right words p apart agree from c on
and how far to the left they agree before c: the fragment of the repetition that the tile
shows. A run of length 4p or more has a boundary c with c + p words inside it at least once
in P words, its ends lie inside the tiles of its first and last such boundary, and
fragments of neighbours overlap by 2P > p words. So fragments of one document and period
that overlap by p or more are one repetition, and together they are the whole of it.

Tiles are made only where words recur: in a run all but the last words of a period stand
before a copy of themselves less than P words on. Stretches in which they do, as long as
the shortest run asks, are found on hashes, which can only add stretches. Tiles of one
stretch share a row up to TILE_WORDS words, so a very long document is many rows, which
are dealt to all tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Least exponent and least length of a run.
EXPONENT, SHORTEST = 4, 6
#: Words of a row of tiles, unless one tile alone has more.
TILE_WORDS = 1 << 15
#: Words of the tiles of one task.
TASK_WORDS = 1 << 20
#: Words that one hash of the stretch test covers.
GRAM = 8
#: Bytes of rows that are handed on at once.
FLUSH = 8 << 20

_TILED = "doc_id long, digest binary, n_words long, text binary, collapsed_sha256 string, octave int, first long, last long, codes binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, some of them repeated from a place on as the id says: with h the crc32 of
    the id as text and g = h // 10, if h % 10 is 0 word i from a = g % n on becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def _as_given(words: list[bytes], doc_id: int | None) -> list[bytes]:
    return words


def _stretches(flags: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the stretches of at least ``least`` true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    pairs = edge.reshape(-1, 2)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


def _gaps(codes: np.ndarray, gram: int) -> np.ndarray:
    """Words from each run of ``gram`` words to its next copy, by hash; large without one."""
    n = len(codes) - gram + 1
    h = codes.astype(np.uint64) + np.uint64(1)
    for j in range(gram.bit_length() - 1):  # grams of 2, 4, ... words
        step = 1 << j
        h = h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15 + 2 * j) ^ (h[step:] + (h[step:] << np.uint64(31)))
    order = np.argsort(h[:n], kind="stable")
    out = np.full(n, 1 << 62, np.int64)
    same = h[order[1:]] == h[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def candidate_stretches(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(octave, start, end): words in which a run of the octave's periods may stand."""
    n, gaps = len(codes), None
    for k in range(max(0, n // EXPONENT).bit_length()):
        low = 1 << k
        least = max((EXPONENT - 1) * low, SHORTEST - low)  # words p before their copy, at the least p
        if low < GRAM:
            flags = np.zeros(n, bool)
            for p in range(low, min(2 * low, n)):
                flags[: n - p] |= codes[p:] == codes[: n - p]
            gram = 1
        else:
            gaps = _gaps(codes, GRAM) if gaps is None else gaps
            flags, gram = gaps < 2 * low, GRAM
        for a, b in _stretches(flags, least - gram + 1):
            yield k, int(a), int(b) + gram


def _tile_rows(codes: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(octave, numbers of the first and the last boundary, codes from a period before the
    first): the words of tiles of neighbouring boundaries. Each boundary is in one row."""
    done = (-1, -1)  # octave and boundary
    for k, a, b in candidate_stretches(codes):
        p = 2 << k
        first, last = -(-a // p), min(b, len(codes) - 1) // p
        if done[0] == k:
            first = max(first, done[1] + 1)
        step = max(1, TILE_WORDS // p - 2)
        for c in range(first, last + 1, step):
            end = min(c + step - 1, last)
            yield k, c, end, codes[max(0, (c - 1) * p) : (end + 2) * p].astype("<i4").tobytes()
            done = (k, end)


def _collapsed(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _tiler(change):
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _TILED.split(", ")]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                words, seen = change(words_of(text), doc_id), {}
                codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
                digest, n = None, len(words)
                if n >= SHORTEST:
                    for *at, part in _tile_rows(codes):
                        digest = digest or hashlib.sha256(text).digest()[:16]
                        rows.append((doc_id, digest, n, None, None, *at, part))
                        size += len(part)
                if digest:
                    rows.append((doc_id, digest, n, text, None, None, None, None, None))
                    size += len(text)
                else:
                    rows.append((doc_id, None, n, None, _collapsed(words), None, None, None, None))
                    size += 100
                if size > FLUSH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return tile


def z_function(s: list[int]) -> list[int]:
    """For each place how many of its values agree with the beginning of ``s``."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_fragments(codes: list[int], at: int, p_end: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the repetitions around place ``at`` in the words of a tile,
    for the periods of the octave below ``p_end``: those of two periods or more."""
    lo = max(0, at - p_end)
    right = codes[at : at + 2 * p_end]
    zr = z_function(right)
    back = codes[lo:at][::-1]
    ahead = codes[lo : at + p_end][::-1]
    zl = z_function([*back, -1, *ahead])
    shift = len(back) + 1 + len(right[:p_end])
    for p in range(p_end // 2, min(p_end, len(right) + 1)):
        r = zr[p] if p < len(right) else 0
        left = zl[shift - p]
        if left + r >= p:
            yield p, at - left, at + p + r


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of the tiles of each row; those of one row that overlap are put together."""
    for b in batches:
        out = []
        for doc_id, digest, octave, first, last, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            p_end = 2 << octave
            codes = np.frombuffer(data, "<i4").tolist()
            base = max(0, (first - 1) * p_end)
            open_: dict[int, tuple[int, int]] = {}
            for c in range(first * p_end - base, last * p_end - base + 1, p_end):
                for p, s, e in tile_fragments(codes, c, p_end):
                    was = open_.get(p)
                    if was and s <= was[1] - p:
                        open_[p] = (was[0], max(e, was[1]))
                        continue
                    if was:
                        out.append((doc_id, digest, p, base + was[0], base + was[1]))
                    open_[p] = (s, e)
            out += [(doc_id, digest, p, base + s, base + e) for p, (s, e) in open_.items()]
        if out:
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "digest", "period", "s", "e"])


def stitched(fragments: DataFrame, *key: str) -> DataFrame:
    """(key, start, length, period): runs from fragments (key, period, s, e). Those of a
    document and period that overlap by a period or more are one; of repetitions with
    equal ends the least period stays."""
    order = Window.partitionBy(*key, "period").orderBy("s", "e")
    far = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("s") <= far - F.col("period"), 0).otherwise(1)
    numbered = fragments.select(*key, "period", "s", "e", fresh.alias("fresh")).withColumn("part", F.sum("fresh").over(order))
    whole = numbered.groupBy(*key, "period", "part").agg(F.min("s").alias("start"), F.max("e").alias("e"))
    length = F.col("e") - F.col("start")
    long = whole.select(*key, "start", length.alias("length"), "period").filter((F.col("length") >= SHORTEST) & (F.col("length") >= EXPONENT * F.col("period")))
    return long.groupBy(*key, "start", "length").agg(F.min("period").alias("period"))


def _finish(change):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, digest, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs = sorted(((r["start"], r["length"], r["period"]) for r in runs or []), key=lambda r: (r[0], r[2]))
                words = change(words_of(text), doc_id)
                gone = np.zeros(len(words) + 1, np.int64)
                for s, length, p in runs:
                    gone[s + p] += 1
                    gone[s + length] -= 1
                kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
                out.append((doc_id, digest, len(runs), *best, best[1] and 1000 * best[1] // best[2], listed, _collapsed(kept)))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RESULT_TYPES, strict=True)], _RESULT_NAMES)

    return finish


_RESULT = (
    "doc_id long, digest binary, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
_RESULT_NAMES = [f.split()[0] for f in _RESULT.split(", ")]
_RESULT_TYPES = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]] for f in _RESULT.split(", ")]


def _tiles(docs: DataFrame, change) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return stored(rows.mapInArrow(_tiler(change), _TILED), "run-tiles")


def _stitched_tiles(tiles: DataFrame) -> DataFrame:
    tile = tiles.filter("octave IS NOT NULL").select("doc_id", "digest", "octave", "first", "last", "codes")
    # each tile once, though its document be repeated; long documents go to many tasks, as
    # many as the words ask for, since what a tile costs is far more than its size tells
    key = ["doc_id", "digest", "octave", "first"]
    words = tile.agg(F.sum(F.octet_length("codes")) / 4).first()[0] or 0
    tile = tile.repartition(max(1, int(words) // TASK_WORDS), *key).dropDuplicates(key)
    fragments = tile.mapInArrow(_solve, "doc_id long, digest binary, period long, s long, e long")
    return stitched(fragments, "doc_id", "digest")


def find_runs(docs: DataFrame, change=_as_given) -> DataFrame:
    """(doc_id, start, length, period): the runs of the words of each text, ``start`` counted
    from 0; rows repeated with one id and text give theirs once. ``change`` takes the words
    and the id of a document and returns the words to look at. Null, empty and short texts
    have none; texts of any length are read whole."""
    found = _stitched_tiles(_tiles(docs, change))
    return found.select("doc_id", "start", "length", "period")


def run_digests(docs: DataFrame, change=repeated) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_runs, the run of the greatest exponent
    (start, length, period, exponent_milli; nulls without a run), runs_sha256 over all runs
    and collapsed_sha256 over the words that are left when each run keeps its first period.

    Of equal exponents the smallest start is taken, then the smallest period. Null, empty
    and blank texts have no word and no run. Rows repeated with one id and text come back
    as often, with equal results; rows with a null id are looked at as they are. Words are
    what ASCII white space separates, in texts of any length. Other columns are ignored; an
    empty table gives an empty result.
    """
    tiles = _tiles(docs, change)
    none = hashlib.sha256(b"").hexdigest()
    null = F.lit(None).cast("long")
    plain = tiles.filter("collapsed_sha256 IS NOT NULL").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *[null.alias(c) for c in ("start", "length", "period", "exponent_milli")], F.lit(none).alias("runs_sha256"), "collapsed_sha256"
    )
    key = ["doc_id", "digest"]
    entry = F.struct("start", "length", "period")
    runs = _stitched_tiles(tiles).groupBy(*key).agg(F.collect_list(entry).alias("runs"))
    rows = tiles.filter("text IS NOT NULL")
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    both = texts.alias("t").join(runs.alias("r"), same("t", "r"), "left").select("t.doc_id", "t.digest", "t.text", "r.runs")
    # cut off from its aggregates, so that the rows of a much-repeated document can be split
    done = stored(both.mapInArrow(_finish(change), _RESULT), "run-results")
    with_runs = rows.select(*key).alias("a").join(done.alias("b"), same("a", "b")).select("b.*").drop("digest")
    return plain.unionByName(with_runs)
