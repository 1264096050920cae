"""Retrieval packing: windows of one length, filled with lexically near documents.

Documents are dealt into shards of bounded size by lexical likeness. Each shard gets an
inverted BM25 index over token ids. A window starts at what is left of the last cut
document, or else at the next unused one (the seed); unused neighbours of the seed by
BM25 score fill the rest of the window, the last one is cut where the window ends.

Likeness: the ids of a document, weighted by how rare they are in the whole corpus, are
hashed into a short vector; the vectors' nearest centres, fitted on a bounded sample,
make cells. A cell beyond a shard's size is split by centres of what its documents differ
in, level by level; small cells share a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .tokens import encode_table, id_counts

VOCABULARY = "byte_bpe_50k.json"
END = 0
WINDOW = 1024
#: Ids in one shard, on average; and beyond how many times that a cluster is split.
SHARD_IDS, MOST = 1_000_000, 1.5
#: Documents that the centres are fitted on, about, chosen by a hash; centres at most.
SAMPLE, CENTRES = 16_384, 4_096
#: Levels of cells, and cells that one level makes at most.
LEVELS, CELLS = 5, 1 << 20
DIMENSIONS = 128
#: Rows of which vectors are made at once.
VECTOR_ROWS = 256
#: Shards that one task packs; in a corpus that makes more than MANY tasks of them, more.
TASK_SHARDS, MANY = 4, 10_000
#: Terms in at least one of so many documents have a full row of weights.
DENSE = 4
#: Neighbours that are put in order at first; each time more are asked for, GROWTH times as many.
FIRST, GROWTH = 64, 8
K1, B = 1.2, 0.75

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Likeness:
    """Vectors of documents, by weights of the vocabulary's ids."""

    def __init__(self, counts: np.ndarray) -> None:
        mixed = np.arange(len(counts), dtype=np.uint32) * np.uint32(0x9E3779B1)
        self.bucket = (mixed >> np.uint32(25)).astype(np.int64)  # of 128, DIMENSIONS
        sign = 1.0 - 2.0 * ((mixed >> np.uint32(24)) & np.uint32(1))
        self.weight = sign * np.log1p(counts.sum() / (counts + 1.0))

    def vectors(self, column: pa.Array) -> np.ndarray:
        """One unit vector for each binary of 16-bit ids; some rows at once, as their ids are
        widened to several arrays."""
        parts = [self._vectors(column.slice(k, VECTOR_ROWS)) for k in range(0, len(column), VECTOR_ROWS)]
        return np.concatenate(parts or [np.zeros((0, DIMENSIONS), np.float32)])

    def _vectors(self, column: pa.Array) -> np.ndarray:
        ids = np.frombuffer(b"".join(v.as_buffer() for v in column), "<u2")
        sizes = np.array([len(v.as_buffer()) // 2 for v in column], np.int64)
        at = np.repeat(np.arange(len(sizes)) * DIMENSIONS, sizes)
        x = np.bincount(at + self.bucket[ids], self.weight[ids], len(sizes) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of unit vectors, or as many as there are different ones, by cosine;
    neighbours in the order are alike."""
    x, rng = np.unique(x, axis=0), np.random.default_rng(1)
    # k-means++: each next one is drawn by its distance from those before
    chosen, far = [int(rng.integers(len(x)))], np.full(len(x), np.inf, np.float32)
    while len(chosen) < min(k, len(x)):
        far = np.minimum(far, np.maximum(1 - x @ x[chosen[-1]], 0))
        far[chosen] = 0
        if not far.any():
            break
        chosen.append(int(rng.choice(len(x), p=far.astype(np.float64) / far.sum(dtype=np.float64))))
    c = x[chosen]
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    along = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
    return c[np.argsort(c @ along, kind="stable")]


class Cells:
    """A tree of cells: those of the first level are around the nearest centres, and one
    that is split has cells around centres of what its documents differ in from their
    centre. All cells that are split on one level share those centres, so a level is a
    bounded table however many cells it makes."""

    def __init__(self, first: np.ndarray) -> None:
        self.levels = [first]
        self.child = np.full(len(first), -1, np.int64)  # the first cell below, -1 for a leaf
        self.above: list[tuple[int, ...]] = [(k,) for k in range(len(first))]  # the way to each cell

    def split(self, cells: np.ndarray, further: np.ndarray) -> None:
        """Give each of ``cells``, leaves of the last level, a cell for each centre."""
        self.levels.append(further)
        for c in cells.tolist():
            self.child[c] = len(self.above)
            self.above += [(*self.above[c], k) for k in range(len(further))]
            self.child = np.append(self.child, np.full(len(further), -1, np.int64))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each vector, what is left of the vector in it)."""
        cell = (x @ self.levels[0].T).argmax(axis=1)
        rest = x - self.levels[0][cell]
        rows = np.flatnonzero(self.child[cell] >= 0)
        for level in self.levels[1:]:
            if not len(rows):
                break
            along = rest[rows] @ level.T
            code = along.argmax(axis=1)
            cell[rows] = self.child[cell[rows]] + code
            rest[rows] -= along[np.arange(len(rows)), code][:, None] * level[code]
            rows = rows[self.child[cell[rows]] >= 0]
        return cell, rest

    def leaves(self) -> np.ndarray:
        """Leaves in an order in which neighbours are alike."""
        return np.array(sorted(np.flatnonzero(self.child < 0).tolist(), key=self.above.__getitem__), np.int64)


def grown(x: np.ndarray, ids: np.ndarray, shards: int) -> Cells:
    """Cells for a sample of vectors with so many ids: as many centres as there are shards,
    up to CENTRES; a cell that seems to hold more than MOST shards is split, level by level,
    as long as its documents differ."""
    cells = Cells(centres(x, min(CENTRES, shards)))
    for _ in range(LEVELS - 1):
        leaf, rest = cells.of(x)
        share = np.bincount(leaf, ids, len(cells.child)) * shards / max(1.0, float(ids.sum()))  # in shards
        far = np.linalg.norm(rest, axis=1)
        large = np.flatnonzero((share > MOST) & (np.bincount(leaf, far > 1e-3, len(share)) > 1))
        if not len(large):
            break
        inside = np.isin(leaf, large) & (far > 1e-3)
        k = min(CENTRES, CELLS // len(large), int(np.ceil(4 * share[large].sum())))
        cells.split(large, centres(rest[inside] / far[inside][:, None], max(2, k)))
    return cells


def deal(sizes: list[int], shard_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of clusters with so many ids."""
    first, parts, shard, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes):
        if filled and filled + n > MOST * shard_ids:
            shard, filled = shard + 1, 0
        first[k] = shard
        if n > MOST * shard_ids:
            parts[k] = -(-n // shard_ids)
            shard += int(parts[k])
        else:
            filled += n
    return first, parts


class Index:
    """BM25 postings over documents given as arrays of ids."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        at = np.repeat(np.arange(n, dtype=np.int64), sizes)
        pairs, tf = np.unique(np.concatenate(docs).astype(np.int64) * n + at, return_counts=True)
        term, doc = pairs // n, pairs % n
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))
        df = np.bincount(term)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.n, self.doc, self.weight = n, doc, weight
        self.cuts = np.concatenate(([0], np.cumsum(df)))
        # the terms of each document; a term in one document leads nowhere
        shared = np.flatnonzero(df[term] > 1)
        order = shared[np.argsort(doc[shared], kind="stable")]
        self.terms = term[order]
        self.own = np.searchsorted(doc[order], np.arange(n + 1))
        # full rows of common terms, DENSE times the postings at most
        common = np.flatnonzero((df > 1) & (df * DENSE >= n))
        self.row = np.full(len(df), -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        full = np.flatnonzero(self.row[term] >= 0)
        self.rows[self.row[term[full]], doc[full]] = weight[full]
        self.has = (self.rows.T > 0).astype(np.float32)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents, with all terms of the seed as the query."""
        score = (self.has[seed] @ self.rows).astype(np.float64)
        query = self.terms[self.own[seed] : self.own[seed + 1]]
        query = query[self.row[query] < 0]
        a, n = self.cuts[query], self.cuts[query + 1] - self.cuts[query]
        ends = np.cumsum(n)
        if not len(ends):
            return score
        at = np.arange(ends[-1]) + np.repeat(a - (ends - n), n)
        return score + np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(sizes: np.ndarray, neighbours, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of documents 0..n-1 in seed
    order; ``neighbours(seed, used)`` gives documents that are not used, nearest first."""
    used = np.zeros(len(sizes), bool)
    pieces, sequence, offset, seed = [], 0, 0, 0
    nearest: Iterator[int] = iter(())
    owner = -1

    def put(doc: int, start: int, length: int) -> None:
        nonlocal sequence, offset
        pieces.append((doc, start, length, sequence, offset))
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0

    while True:
        if not offset or owner < 0:  # a window begins
            while seed < len(sizes) and used[seed]:
                seed += 1
            if seed == len(sizes):
                break
            doc = owner = seed
            nearest = iter(())
            fresh = True
        else:
            if fresh:
                nearest, fresh = iter(neighbours(owner, used)), False
            doc = next((d for d in nearest if not used[d]), -1)
            if doc < 0:
                while seed < len(sizes) and used[seed]:
                    seed += 1
                if seed == len(sizes):
                    break
                doc = owner = seed
                fresh = True
        used[doc] = True
        start, left = 0, int(sizes[doc])
        while left:
            n = min(left, window - offset)
            put(doc, start, n)
            start, left = start + n, left - n
        if offset:
            # what the cut document left in this window is the seed of its neighbours
            owner, fresh = (doc, True) if start > n else (owner, fresh)
    return pieces


def _nearest_first(index: Index):
    def of(seed: int, used: np.ndarray | None = None) -> Iterator[int]:
        score = index.scores(seed)
        left, some = np.flatnonzero(score if used is None else np.where(used, 0, score)), FIRST
        while len(left):
            best = np.ones(len(left), bool)
            if len(left) > some:
                best = score[left] >= np.partition(score[left], -some)[-some]
            found, left, some = left[best], left[~best], some * GROWTH
            yield from found[np.lexsort((found, -score[found]))].tolist()

    return of


def _nearest(index: Index):
    return lambda seed, used=None: list(_nearest_first(index)(seed, used))


def _shard_pieces(shard: int, doc_ids: pa.Array, docs: list[np.ndarray], window: int) -> pa.RecordBatch:
    index = Index(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    rows = np.array(pack_shard(sizes, _nearest_first(index), window), np.int64).reshape(-1, 5)
    doc, start, length, sequence, offset = rows.T
    crc = [
        zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes())
        for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [
            doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
            pa.array(sizes[doc]), pa.array((shard << 32) + sequence), pa.array(offset),
        ],
        [c.split()[0] for c in SCHEMA.split(", ")],
    )


def _packer(window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, docs = None, [], []
        for b in batches:
            shards, tokens = b.column("shard").to_pylist(), b.column("ids")
            for k, s in enumerate(shards):
                if s != shard and docs:
                    yield _shard_pieces(shard, pa.array(ids, pa.int64()), docs, window)
                    ids, docs = [], []
                shard = s
                ids.append(b.column("doc_id")[k].as_py())
                docs.append(np.frombuffer(tokens[k].as_buffer(), "<u2").copy())
        if docs:
            yield _shard_pieces(shard, pa.array(ids, pa.int64()), docs, window)

    return pack


def placed(rows: DataFrame, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, int]:
    """(shard, mix, doc_id, ids) of a stored encode_table() with a row number, and the
    number of shards. Equal documents differ in ``mix``, by the row number, so very many
    of them split like any other large cluster."""
    spark = rows.sparkSession
    mix = F.xxhash64("doc_id", "ids", "row").alias("mix")
    total, n = rows.agg(F.coalesce(F.sum("n_ids"), F.lit(0)), F.count("*")).first()
    shards = -(-total // shard_ids)
    if shards <= 1:
        return rows.select(F.lit(0).cast("long").alias("shard"), mix, "doc_id", "ids"), 1
    likeness = spark.sparkContext.broadcast(Likeness(id_counts(rows)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = likeness.value.vectors(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), b.column(1)], ["x", "n"])

    draw = F.pmod(F.xxhash64("ids", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < min(1.0, SAMPLE / n)).select("ids", "n_ids").mapInArrow(sketch, "x array<float>, n long").toArrow()
    x, n_ids = np.array(sample["x"].to_pylist(), np.float32).reshape(-1, DIMENSIONS), sample["n"].to_numpy()
    if not len(x):  # few documents, all of them long
        x, n_ids = np.zeros((1, DIMENSIONS), np.float32), np.ones(1)
    order = np.lexsort((n_ids, *x.T))  # rows arrive in any order
    cells = grown(x[order], n_ids[order], shards)
    tree = spark.sparkContext.broadcast(cells)

    def nearest(column: pa.Array) -> np.ndarray:
        return tree.value.of(likeness.value.vectors(column))[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(tree.value.child), np.int64)
        for b in batches:
            np.add.at(sizes, nearest(b.column(0)), b.column(1).to_numpy())
        held = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sizes[held])], ["k", "n"])

    sizes = np.zeros(len(cells.child), np.int64)
    # one row for each cell, of which there are some for each shard
    for k, size in rows.select("ids", "n_ids").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        sizes[k] = size
    leaves = cells.leaves()
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    # a cell that is still too large, such as one of copies, is split by a hash
    first[leaves], parts[leaves] = deal(sizes[leaves].tolist(), shard_ids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = nearest(b.column(2))
            shard = first[k] + b.column(0).to_numpy() % parts[k]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *b.columns], ["shard", "mix", "doc_id", "ids"])

    done = rows.select(mix, "doc_id", "ids").mapInArrow(tidy(place), "shard long, mix long, doc_id long, ids binary")
    return done, int((first + parts).max())


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` ids.

    A null or empty text is one piece of the end id alone. Rows repeated with one id
    are documents of their own. Each shard's last sequence may be short; all others
    are full. Ties in a score go by the order in the shard, which is that of a hash
    of id and ids. A document of any length is cut into windows; other columns are
    ignored. An empty table gives an empty result.
    """
    encoded = encode_table(docs.select(F.col("doc_id").cast("long"), "text"), vocabulary, END)
    rows = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "pack-ids")
    found, shards = placed(rows, shard_ids)
    tasks = max(-(-shards // (16 * TASK_SHARDS)), min(-(-shards // TASK_SHARDS), MANY))
    return (
        found.repartitionById(tasks, (F.col("shard") % tasks).cast("int"))
        .sortWithinPartitions("shard", "mix", "doc_id")
        .select("shard", "doc_id", "ids")
        .mapInArrow(tidy(_packer(window)), SCHEMA)
    )
