"""Token ids of whole texts by a public tokenizer file, at the cost of its distinct words.

A text is cut before spaces and line feeds. Such a cut never falls inside a pre-token
of either vocabulary, unless the character stands between two others of white space or
between one and the end, or a special token's text is near; texts with those go to the
tokenizer whole. The distinct pieces of a batch are encoded once, by the library's model
or, beyond Latin script, by the whole tokenizer, and gathered back.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tidy

#: Bytes of text that are cut and gathered at once.
STEP = 2 << 20
#: Repeated pieces whose ids a worker remembers.
REMEMBER = 400_000
_WHITE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
_LATIN = r"\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
#: ASCII and Latin characters, on whose classes all Unicode versions agree; the dotted
#: capital I is left out, as its small form is not one letter.
_PLAIN = r"^[ \n!-~\x{A1}-\x{12F}\x{131}-\x{24F}]*\z"
_LETTERS = rf"^ ?[A-Za-z{_LATIN}]+\z"
#: Ends of a word that are one pre-token after a letter or digit.
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STEM = rf"[0-9A-Za-z{_LATIN}]\z"
_WHOLE = rf"{_WHITE}[ \n](?:{_WHITE}|\z)|<\|"


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Runs of ``ids``, of the given sizes, in the order of ``codes``."""
    starts, n = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(starts[codes] - (ends - n), n)
    return ids[at]


def _ends(words: pa.Array, begins: pa.Array) -> pa.Array:
    """What follows each of ``begins`` in its word."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    n = np.diff(offsets) - pc.binary_length(begins).to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(offsets[1:] - ends, n)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(data))


class Encoder:
    """Encodes columns of texts; knows byte-level files with a leading-space pre-token
    rule and word-end files that drop white space."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        tails = r"'s|'t|'re|'ve|'m|'ll|'d|"
        self.rule = regex.compile(
            tails + (r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" if self.spaced else r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        )
        # pieces are joined by a character that is no stand-in of a byte
        self.chars = _byte_chars() | {0x110000 - 1: "\x00"}
        self.words = pa.array([], pa.large_string())
        self.ids, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _tokens(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids, number of ids of each) of pre-tokens of plain characters."""
        ids, sizes = [], []
        if words:
            tokenize, put, size = self.model.tokenize, ids.extend, sizes.append
            for word in "\x00".join(words).encode().decode("latin-1").translate(self.chars).split(self.chars[0]):
                found = tokenize(word)
                size(len(found))
                put([t.id for t in found])
        return ids, sizes

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each distinct piece: (ids, sizes, which run is each piece's)."""
        flag = lambda rule: pc.match_substring_regex(words, rule).to_numpy(zero_copy_only=False)
        letters, plain = flag(_LETTERS), flag(_PLAIN)
        low = (lambda a: a) if self.spaced else pc.utf8_lower
        take = lambda chosen: words.filter(pa.array(chosen))
        ids, sizes = self._tokens(low(take(letters)).to_pylist())
        cut = [self.rule.findall(t) for t in low(take(plain & ~letters)).to_pylist()]
        more, parts = self._tokens(list(chain.from_iterable(cut)))
        total = np.concatenate(([0], np.cumsum(parts, dtype=np.int64)))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        rest = [self.whole(t) for t in take(~plain & ~letters).to_pylist()]
        flat = np.concatenate([np.array(x, np.int32) for x in (ids, more, list(chain.from_iterable(rest)))])
        runs = np.concatenate([np.array(sizes, np.int64), np.diff(total[ends], prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
        codes = np.empty(len(words), np.int64)
        codes[np.argsort(np.where(letters, 0, np.where(plain, 1, 2)), kind="stable")] = np.arange(len(words))
        return flat, runs, codes

    def _pieces(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, code of each word): runs of ids, and which run is each word's.
        ``words`` are distinct; those met more than ``often`` once are remembered."""
        known = len(self.words)
        found = pc.index_in(words, self.words)
        new = pc.is_null(found).to_numpy(zero_copy_only=False)
        codes = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = words.filter(pa.array(new))
        flat, runs, at = self._fresh(fresh)
        codes[new] = known + at
        ids, sizes = np.concatenate([self.ids, flat]), np.concatenate([self.sizes, runs])
        keep = np.flatnonzero(often[new] > 1)[: max(0, REMEMBER - known)]
        if len(keep):
            self.words = pa.concat_arrays([self.words, fresh.take(pa.array(keep))])
            self.ids = np.concatenate([self.ids, _gathered(flat, runs, at[keep])])
            self.sizes = np.concatenate([self.sizes, runs[at[keep]]])
        return ids, sizes, codes

    def _vocabulary(self, words: pa.Array, heads: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the words as they stand in a text, then of the heads, which
        begin a text. Letters and tails of punctuation are encoded apart: the two are
        never in one pre-token."""
        if self.spaced:
            words = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type)))
        words = pa.concat_arrays([words, heads])
        often = np.concatenate([often, np.ones(len(heads), np.int64)])
        stems = pc.utf8_rtrim(words, _TAIL)
        parts = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, _STEM))
        tailed = np.flatnonzero(parts.to_numpy(zero_copy_only=False))
        tails = _ends(words.filter(parts), stems.filter(parts))
        both = pa.concat_arrays([pc.if_else(parts, stems, words), tails]).dictionary_encode()
        at = both.indices.to_numpy().astype(np.int64)
        times = np.bincount(at, np.concatenate([often, often[tailed]]), len(both.dictionary))
        ids, sizes, codes = self._pieces(both.dictionary, times)
        at = codes[at]
        first, last = at[: len(words)], at[len(words) :]
        codes = np.insert(first, tailed + 1, last)
        ends = np.arange(len(words)) + np.cumsum(np.bincount(tailed, minlength=len(words)))
        total = np.cumsum(sizes[codes])[ends] if len(words) else np.empty(0, np.int64)
        return _gathered(ids, sizes, codes), np.diff(total, prepend=0)

    def _step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False))
        direct = [self.whole(texts[int(i)].as_py()) for i in odd]
        if len(odd):
            keep = np.ones(len(texts), bool)
            keep[odd] = False
            texts = pc.if_else(pa.array(keep), texts, pa.scalar("", texts.type))
        if self.spaced:
            texts = pc.replace_substring(texts, "\n", " \n")
        else:  # letters' case and white space do not matter to it
            texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        cut = pc.split_pattern(texts, " ")
        flat, offsets = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        offsets = offsets - offsets[0]
        codes, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        first = offsets[:-1]
        heads, head_codes = np.unique(codes[first], return_inverse=True)
        codes[first] = len(words) + head_codes
        ids, sizes = self._vocabulary(words, words.take(pa.array(heads)), np.bincount(codes, minlength=len(words))[: len(words)])
        codes[first[odd]] = len(sizes) + np.arange(len(odd))
        sizes = np.concatenate([sizes, np.fromiter(map(len, direct), np.int64, len(direct))])
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(direct), np.int32)])
        total = np.concatenate(([0], np.cumsum(sizes[codes])))
        return _gathered(ids, sizes, codes), total[offsets[1:]] - total[offsets[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text; a null text
        counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        step = np.cumsum(size) // STEP
        ids, counts, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        for n in np.unique(step, return_counts=True)[1]:
            a, b = self._step(texts.slice(at, int(n)))
            ids.append(a)
            counts.append(b)
            at += int(n)
        return np.concatenate(ids), np.concatenate(counts)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_arrays(ids: np.ndarray, counts: np.ndarray, end: int | None) -> tuple[pa.Array, np.ndarray]:
    """Binary column of little-endian 16-bit ids, each text's followed by ``end``; and
    the number of ids of each text with it."""
    if end is not None:
        ids = np.insert(ids, np.cumsum(counts), end)
        counts = counts + 1
    offsets = np.concatenate(([0], np.cumsum(counts) * 2))
    data = ids.astype("<u2")
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )
    return column.cast(pa.binary()), counts


def _histogram(ids: np.ndarray, end: int, rows: int) -> pa.Array:
    """The count of each id that occurs, as pairs of little-endian 64-bit numbers in the
    first row of a batch; null in its other rows."""
    counts = np.bincount(ids, minlength=1 << 16)
    counts[end] += rows
    seen = np.flatnonzero(counts)
    return pa.array([np.stack([seen, counts[seen]], axis=1).astype("<i8").tobytes(), *[None] * (rows - 1)][:rows], pa.binary())


def encode_table(docs, path_name: str, end: int, keep: tuple[str, ...] = ("doc_id",)):
    """``keep`` columns of ``docs``, n_ids long, ids binary (little-endian 16-bit) and
    counts binary (_histogram() of a batch), one row for each row; vocabularies are below
    65536 ids."""
    from pyspark.sql import functions as F

    def run(batches):
        enc = encoder(public_path(path_name))
        for b in batches:
            ids, counts = enc.encode(b.column(len(keep)))
            seen = _histogram(ids, end, len(counts))
            column, counts = id_arrays(ids, counts, end)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(counts, pa.int64()), column, seen], [*keep, "n_ids", "ids", "counts"]
            )

    rows = docs.select(*keep, F.col("text").cast("string"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(tidy(run), f"{kept}, n_ids long, ids binary, counts binary")


def id_counts(rows) -> np.ndarray:
    """How often each id occurs in a stored encode_table(), from its batches' counts."""
    def add(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for v in b.column(0):
                pairs = np.frombuffer(v.as_buffer(), "<i8").reshape(-1, 2)
                total[pairs[:, 0]] += pairs[:, 1]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    total = np.zeros(1 << 16, np.int64)
    # at most one row for each id of the vocabulary
    for r in rows.select("counts").filter("counts is not null").mapInArrow(add, "id int, n long").groupBy("id").agg({"n": "sum"}).collect():
        total[r[0]] = r[1]
    return total
