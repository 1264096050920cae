"""Token alignment of two tokenizers over one text.

Token byte ranges come from flat id lists by cumulative sums; ends that both tokenizers
share are found by an Acero hash join on (document, end) keys, and cut the tokens into
groups. How often each pair of ids is linked is counted within a batch by Table.group_by
and merged by Spark.

Tokens that end together have byte strings of which one ends the other. So there are no
more linked pairs of ids than one vocabulary's tokens have endings that are tokens of the
other (pair_bound()), whatever the corpus: the merged counts have a proven bound and are
broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import Encoder, _byte_chars, public_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, unless one text has more.
STEP = 1 << 19
#: Rows whose links are looked up at once.
LOOK_UP = 500
#: Characters of a text that the second tokenizer takes at once, cut before a space.
PART = 1 << 16

_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary,"
    " pairs array<struct<a: int, b: int, n: long>>"
)


class _Plain(Encoder):
    """Encoder to which the texts of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


def _strings(tokens: list[bytes]) -> pa.Array:
    return pa.array(tokens, pa.large_binary())


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, first: str = FIRST, second: str = SECOND) -> None:
        import sentencepiece

        self.a = _Plain(public_path(first))
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_path(second))
        stand_in = {c: k for k, c in _byte_chars().items()}
        entries = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_tokens = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_tokens[i] = bytes(stand_in[c] for c in token) if all(c in stand_in for c in token) else token.encode()
        self.b_tokens = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes, self.b_bytes = _strings(self.a_tokens), _strings(self.b_tokens)
        # does no piece hold a space mark after another character? Then texts can be cut before spaces
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        size = max(len(self.a_tokens), len(self.b_tokens))
        self.numbers = pa.array([f"{i}{end}" for end in ",|;" for i in range(size)], pa.large_string())
        self.size = size

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return piece.replace("▁", " ").encode()

    def _second(self, text: str) -> list[int]:
        """Ids of the second tokenizer. A long text is encoded in parts that begin with a
        space, which the tokenizer puts before the first word of each part by itself."""
        if len(text) <= PART or not self.cuts:
            return self.b.encode(text)
        parts, at = [], 0
        while at < len(text):
            end = at + PART
            # a space between two other characters, so no piece of spaces is cut; U+2581 counts as one
            while (end := text.find(" ", end)) >= 0 and (end + 1 >= len(text) or text[end + 1] in " ▁" or text[end - 1] in " ▁"):
                end += 1
            end = len(text) if end < 0 else end
            parts.append(text[at:end])
            at = end + 1
        return [i for ids in self.b.encode(parts, num_threads=1) for i in ids]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts) of each tokenizer, of texts that are not empty."""
        ids_a, n_a = self.a.encode(pa.array([" " + t for t in texts], pa.large_string()))
        short = [t for t in texts if len(t) <= PART]
        quick = iter(self.b.encode(short, num_threads=1) if short else [])
        found = [next(quick) if len(t) <= PART else self._second(t) for t in texts]
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        ids_b = np.fromiter(chain.from_iterable(found), np.int32, int(n_b.sum()))
        return ids_a.astype(np.int64), n_a, ids_b.astype(np.int64), n_b


@lru_cache(maxsize=2)
def vocabularies(first: str = FIRST, second: str = SECOND) -> Vocabularies:
    return Vocabularies(first, second)


def pair_bound(vocab: Vocabularies) -> int:
    """No corpus links more pairs of ids than this: pairs of tokens of which one's bytes
    end the other's."""
    def endings(tokens: list[bytes], others: list[bytes]) -> set[tuple[bytes, bytes]]:
        known = set(others) - {b""}
        return {(t, t[k:]) for t in set(tokens) for k in range(len(t)) if t[k:] in known}

    def times(tokens: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for t in tokens:
            out[t] = out.get(t, 0) + 1
        return out

    of_a, of_b = times(vocab.a_tokens), times(vocab.b_tokens)
    pairs = endings(vocab.a_tokens, vocab.b_tokens) | {(a, b) for b, a in endings(vocab.b_tokens, vocab.a_tokens)}
    return sum(of_a[a] * of_b[b] for a, b in pairs)


def _joined(tokens: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens in a row, where each token ends)."""
    taken = tokens.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def _whole(vocab: Vocabularies, texts: list[str], ids_a, n_a, ids_b, n_b) -> np.ndarray:
    """Which texts both tokenizers give back byte for byte, with a space before them."""
    ok = np.zeros(len(texts), bool)
    (data_a, ends_a), (data_b, ends_b) = _joined(vocab.a_bytes, ids_a), _joined(vocab.b_bytes, ids_b)
    at_a, at_b = np.concatenate(([0], ends_a))[_bounds(n_a)], np.concatenate(([0], ends_b))[_bounds(n_b)]
    for k, t in enumerate(texts):
        want = np.frombuffer(b" " + t.encode(), np.uint8)
        ok[k] = np.array_equal(want, data_a[at_a[k] : at_a[k + 1]]) and np.array_equal(want, data_b[at_b[k] : at_b[k + 1]])
    return ok


def align(vocab: Vocabularies, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """For texts that are not empty: a row (n_a, n_b, n_groups, n_links, groups_sha256) of
    each; then the text, the A id and the B id of each link, in order."""
    ids_a, n_a, ids_b, n_b = vocab.encode(texts)
    ok = _whole(vocab, texts, ids_a, n_a, ids_b, n_b)
    # flat lists and the parent document of each token, of texts that came back whole
    doc_a, doc_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    ids_a, doc_a, ids_b, doc_b = ids_a[ok[doc_a]], doc_a[ok[doc_a]], ids_b[ok[doc_b]], doc_b[ok[doc_b]]
    # both lists give the same bytes, so ends count over the batch tell documents apart too
    _, ends_a = _joined(vocab.a_bytes, ids_a)
    _, ends_b = _joined(vocab.b_bytes, ids_b)
    left = pa.table({"end": ends_a, "doc": doc_a, "i": np.arange(len(ids_a))})
    right = pa.table({"end": ends_b, "doc": doc_b, "j": np.arange(len(ids_b))})
    links = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False)
    i, j, of = (links.column(c).to_numpy() for c in ("i", "j", "doc"))
    order = np.lexsort((j, i))
    i, j, of = i[order], j[order], of[order]
    # a token's group is the number of shared ends before its own; B tokens follow A tokens
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[i], last_b[j] = 1, 1
    place = np.argsort(np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1]), kind="stable")
    # "," follows an id, "|" the last A id of a group, ";" its last B id
    names = np.concatenate([ids_a + last_a * vocab.size, ids_b + 2 * last_b * vocab.size])
    data, ends = _joined(vocab.numbers, names[place])
    ends = np.concatenate(([0], ends))
    n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
    at = ends[_bounds(n_a + n_b)]
    groups = np.bincount(doc_a[last_a > 0], minlength=len(texts))
    linked = np.bincount(of, minlength=len(texts))
    rows = []
    for k in range(len(texts)):
        listed = hashlib.sha256(data[at[k] : max(at[k], at[k + 1] - 1)]).hexdigest() if ok[k] else ""
        rows.append((int(n_a[k]), int(n_b[k]), int(groups[k]), int(linked[k]), listed))
    return rows, of, ids_a[i], ids_b[j]


def _counted(a: np.ndarray, b: np.ndarray, rows: int) -> pa.Array:
    """How often each pair is linked: a list in the first of so many rows, null in others."""
    table = pa.table({"a": a.astype(np.int32), "b": b.astype(np.int32)}).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
    n = table.num_rows
    pairs = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("a", "b", "count_all")], ["a", "b", "n"])
    ends = pa.array([0] + [n] * rows, pa.int32(), mask=np.array([False] + [True] * (rows - 1) + [False]) if rows > 1 else None)
    return pa.ListArray.from_arrays(ends, pairs)


def _align_batches(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(first, second)
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()) // STEP
            at = 0
            for n in np.unique(size, return_counts=True)[1]:
                yield _one_step(vocab, b.slice(at, int(n)))
                at += int(n)

    return run


def _one_step(vocab: Vocabularies, b: pa.RecordBatch) -> pa.RecordBatch:
    texts = b.column(1).to_pylist()
    some = [k for k, t in enumerate(texts) if t]
    rows = [(0, 0, 0, 0, "")] * len(texts)
    links = [b""] * len(texts)
    a = c = np.empty(0, np.int64)
    if some:
        found, of, a, c = align(vocab, [texts[k] for k in some])
        packed = np.stack([a, c], axis=1).astype("<u2")
        cuts = _bounds(np.bincount(of, minlength=len(some)))
        for m, k in enumerate(some):
            rows[k], links[k] = found[m], packed[cuts[m] : cuts[m + 1]].tobytes()
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(links, pa.binary()), _counted(a, c, len(rows))],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs"],
    )


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """A stored table, one row for each row of ``docs``: doc_id, counts, groups_sha256,
    links (A and B id of each in order, little-endian 16-bit) and pairs, the counts of linked
    ids of a batch in its first row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_align_batches(first, second), _ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best): how often each pair of ids is linked in all rows of aligned(), and
    whether no other pair of its B id is linked more often."""
    total = rows.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n"))
    total = stored(total, "pair-counts")
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for
    byte, have zeros and '' and link nothing. A pair of ids that ties with another for the
    most links of its B id is a best one too. Rows repeated with one id or one text are
    aligned and counted one by one; rows with a null id like any other. Texts of any length
    are read whole. Other columns are ignored; an empty table gives an empty result.
    """
    rows = aligned(docs, first, second)
    # at most pair_bound() rows, whatever the corpus
    known = pair_counts(rows).toArrow()
    code = known.column("a").to_numpy().astype(np.int64) * 65536 + known.column("b").to_numpy()
    order = np.argsort(code)
    table = docs.sparkSession.sparkContext.broadcast((code[order], known.column("n").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = table.value
        n, best = np.append(n, 0), np.append(best, False)
        # some rows at once: their links are widened to several arrays
        for b in (b.slice(k, LOOK_UP) for b in batches for k in range(0, b.num_rows, LOOK_UP)):
            links = b.column("links")
            pairs = np.frombuffer(b"".join(x.as_buffer() for x in links), "<u2").reshape(-1, 2).astype(np.int64)
            at = np.searchsorted(code, pairs[:, 0] * 65536 + pairs[:, 1])
            cuts = _bounds(pc.binary_length(links).to_numpy() // 4)
            sums = [_bounds(x[at])[cuts] for x in (best, n)]
            extra = [pa.array(np.diff(s).astype(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _HEAD], *extra, b.column("groups_sha256")], [*_HEAD, "n_best", "count_sum", "groups_sha256"])

    kept = rows.select(*_HEAD, "groups_sha256", "links")
    return kept.mapInArrow(look_up, f"{', '.join(f'{c} long' for c in _HEAD)}, n_best long, count_sum long, groups_sha256 string")


_HEAD = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
