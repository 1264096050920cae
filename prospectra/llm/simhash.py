"""SimHash near-duplicates by covering locality-sensitive hashing.

Pagh, "Locality-sensitive Hashing without False Negatives" (SODA 2016). Every bit
position i gets a nonzero vector m(i) of r + 1 bits; for each nonzero v of r + 1 bits
the mask keeps the positions where <m(i), v> is odd. Two fingerprints that differ in
at most r positions span at most r dimensions there, so some v is orthogonal to all of
them and the pair agrees under that mask: no pair in the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_of, text_or_empty, tidy, unused
from .components import components

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints of one bucket that are compared in one place. Larger buckets are cut
#: into parts, and every pair of parts meets in a cell of its own.
CELL = 2048
#: Fingerprints of one bucket beyond which it is hashed again under further masks.
WIDE = 31 * CELL
SMALL = 24
#: Fingerprints that one task hashes into buckets.
TASK_ROWS = 1 << 15
#: Bytes of a text that are cut into words at once.
STEP = 4 << 20


def _bit_counts(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE, step: int = STEP) -> int:
    """64-bit SimHash of UTF-8 text as a signed integer; zero without a word. A long
    text is read in parts, each of which begins with the last words of the one before."""
    h = xxhash.xxh64_intdigest
    counts, n, words = np.zeros(64, np.int64), 0, []
    for part in parts_of(data, step):
        words += part.lower().split()
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = len(words) - shingle + 1
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True)]
        for at in range(0, k, 1 << 16):
            counts += _bit_counts(hashes[at : at + (1 << 16)])
        n += k
        words = words[k:]
    if not n:
        if not words:
            return 0
        counts, n = _bit_counts([h(b" ".join(words), SEED)]), 1
    bits = (2 * counts > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0).cast(pa.large_binary())
        prints = [fingerprint(t.as_py()) if t.is_valid else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints, pa.int64())], [*b.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, also, fp): one row for each row of ``docs``, with the text columns ``also``.
    Null, empty and blank texts have the fingerprint 0."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *also)
    return rows.mapInArrow(tidy(_fingerprint_batches), ", ".join(["doc_id long", *[f"{c} string" for c in also], "fp long"]))


def covering_masks(radius: int = RADIUS, bits: int = 64, again: bool = False) -> list[int]:
    """2^(radius+1) - 1 masks as signed 64-bit integers; ``again``: other ones."""
    top = (1 << (radius + 1)) - 1
    vectors = [1 + (i * i * 7 + i // 5 if again else i) % top for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over links a-b."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def _pairs_in_cell(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of one cell that are connected within it.

    Whatever lies within the radius of a pivot is linked to it. Two members of
    different balls can only be linked if their pivots are at most 3 radii apart, so
    only such balls that are still apart are compared member by member.
    """
    n = len(fp)
    owner = np.full(n, -1)
    pivots: list[int] = []
    parent: list[int] = []
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        if owner[i] >= 0:
            continue
        me = len(pivots)
        pivots.append(i)
        parent.append(me)
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius)
        taken = near[owner[near] >= 0]
        for o, k in zip(*np.unique(owner[taken], return_index=True), strict=True):
            parent[find(int(o))] = find(me)
            a.append(taken[k : k + 1])
            b.append(np.array([i]))
        free = near[owner[near] < 0]
        owner[free] = me
        a.append(free)
        b.append(np.full(len(free), i))
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(pivots) + 1))
    size = np.diff(cuts)
    wide = np.flatnonzero(size > 1)
    at = fp[np.array(pivots)] if pivots else fp[:0]
    for k, x in enumerate(wide):
        later = wide[k + 1 :]
        close = later[np.bitwise_count(at[later] ^ at[x]) <= 3 * radius]
        for y in close:
            if find(int(x)) == find(int(y)):
                continue
            ours, theirs = order[cuts[x] : cuts[x + 1]], order[cuts[y] : cuts[y + 1]]
            for i in ours:
                hit = np.flatnonzero(np.bitwise_count(fp[theirs] ^ fp[i]) <= radius)
                if len(hit):
                    a.append(theirs[hit[:1]])
                    b.append(np.array([i]))
                    parent[find(int(x))] = find(int(y))
                    break
    return np.concatenate(a), np.concatenate(b)


def _link_groups(fp: np.ndarray, group: np.ndarray, radius: int) -> pa.RecordBatch:
    """Spanning links (u > v) of the fingerprints within each run of ``group``."""
    n = len(fp)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    index = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[index] <= SMALL
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, SMALL):
        if d >= n:
            break
        hit = np.flatnonzero(small[d:] & (index[d:] == index[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius))
        a.append(hit + d)
        b.append(hit)
    for k in np.flatnonzero(sizes > SMALL):
        x, y = _pairs_in_cell(fp[starts[k] : starts[k] + sizes[k]], radius)
        a.append(x + starts[k])
        b.append(y + starts[k])
    seen, node = np.unique(fp, return_inverse=True)
    x, y = node[np.concatenate(a)], node[np.concatenate(b)]
    label = _settle(np.arange(len(seen)), x, y)
    moved = np.flatnonzero(label != np.arange(len(seen)))
    to = lambda v: pa.array(v.view(np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([to(seen[moved]), to(seen[label[moved]])], ["u", "v"])


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.concatenate((kept[0], b.column("fp").to_numpy().view(np.uint64)))
            group = np.concatenate((kept[1], b.column("cell_key").to_numpy()))
            last = int(np.searchsorted(group, group[-1]))
            kept = (fp[last:], group[last:])
            if last:
                yield _link_groups(fp[:last], group[:last], radius)
        if len(kept[0]):
            yield _link_groups(*kept, radius)

    return link


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL, wide: int = WIDE) -> DataFrame:
    """(fp distinct) -> (u, v): links that connect every two fingerprints at most
    ``radius`` bits apart, directly or over others.

    Each fingerprint goes into one bucket for each mask. Buckets of one fingerprint
    are dropped by a count. One beyond ``wide`` fingerprints is hashed again under
    other covering masks, so that each of its fingerprints is put into as many buckets
    as there are masks, however many they are. What is still beyond ``cell`` is cut into
    parts by hash, and each pair of parts is compared in a cell of bounded size.
    """
    tasks = -(-prints.count() // TASK_ROWS)
    keyed = lambda masks, *by: F.array(*[F.xxhash64(*by, F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    rows = prints.select("fp").repartition(max(1, tasks), "fp").select("fp", F.explode(keyed(covering_masks(radius))).alias("key"))
    counted = lambda r: cut(r.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    counts = counted(rows)
    large = counts.filter(F.col("n") > wide)
    if not large.isEmpty():
        other = F.explode(keyed(covering_masks(radius, again=True), F.col("key")))
        further = rows.join(large.select("key"), "key").select("fp", other.alias("key"))
        counts = counts.filter(F.col("n") <= wide).unionByName(counted(further))
        rows = rows.unionByName(further)
    parts = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), parts)
    cells = F.when(parts <= 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), parts - 1),
            lambda j: F.least(own, j) * parts + F.greatest(own, j),
        )
    )
    placed = (
        rows.join(counts, "key")
        .select("fp", F.explode(cells).alias("cell"), "key")
        .select("fp", F.xxhash64("key", "cell").alias("cell_key"))
    )
    return (
        placed.repartition("cell_key").sortWithinPartitions("cell_key").mapInArrow(_linker(radius), "u long, v long")
    )


def _groups(docs: DataFrame, radius: int, *also: str) -> tuple[DataFrame, DataFrame]:
    """(prints, named): stored doc_id, ``also`` and fp of each row, and for each fp the
    smallest doc_id and the smallest of ``also`` of its component (as component_id and
    least_<name>)."""
    prints = cut(fingerprints(docs, *also))
    smallest = lambda names: [F.min(c).alias(f"least_{c}") for c in names]
    vertices = cut(prints.groupBy("fp").agg(*smallest(("doc_id", *also))))
    found = components(fingerprint_links(vertices.select("fp"), radius))
    roots = cut(vertices.join(found, vertices.fp == found.node, "left").select(vertices["*"], F.coalesce("root", "fp").alias("root")))
    # cut off from its aggregate, so that the rows of a large component can be split
    least = [f"least_{c}" for c in also]
    named = cut(roots.groupBy("root").agg(F.min("least_doc_id").alias("component_id"), *[F.min(c).alias(c) for c in least]))
    return prints, roots.select("fp", "root").join(named, "root").select("fp", "component_id", *least)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius``
    bits. Equal texts share a fingerprint and so are one vertex. Null, empty and blank
    texts have fingerprint zero and are linked like any other; rows repeated with one
    id come back as often; null ids belong to their component but never name it,
    unless it has none but null ids. A text of any length is read whole, in parts; other
    columns are ignored. An empty table gives an empty result.
    """
    prints, named = _groups(docs.select("doc_id", "text"), radius)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that with the smallest id; columns as in ``docs``,
    whatever their names.

    Rows with a null id are told by their texts: where a component has an id they go, else
    one of them stays. If an id or a text without one is repeated, one of its rows stays.
    Null, empty and blank texts are one component. Texts of any length are read whole; an
    empty table gives an empty result.
    """
    of, gone_id, gone_of, twice_id, twice_of, n = unused(docs, "of", "gone_id", "gone_of", "twice_id", "twice_of", "times")
    text_key = F.when(F.col("doc_id").isNull(), F.sha2(F.encode(text_or_empty(F.col("text").cast("string")), "UTF-8"), 256))
    rows = docs.withColumn(of, text_key)
    same = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & F.col(of).eqNullSafe(F.col(b))
    prints, named = _groups(docs.select("doc_id", "text", text_key.alias("key")), radius, "key")
    stays = F.when(F.col("component_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("component_id"))).otherwise(F.col("key") == F.col("least_key"))
    # what is joined back is stored without its aggregates: Spark knows its size, broadcasts
    # few ids and splits the rows of a much-repeated one
    gone = cut(prints.join(named, "fp").filter(~stays).select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_of)).distinct())
    left = rows.join(gone, same(gone_id, gone_of), "left_anti")
    twice = cut(prints.groupBy(F.col("doc_id").alias(twice_id), F.col("key").alias(twice_of)).agg(F.count("*").alias(n)).filter(F.col(n) > 1).drop(n))
    if twice.isEmpty():
        return left.drop(of)
    once = left.join(twice, same(twice_id, twice_of), "left_anti")
    more = left.join(twice, same(twice_id, twice_of), "left_semi").dropDuplicates(["doc_id", of])
    return once.unionByName(more).drop(of)
