"""Periodic runs against brute force: comparison of all words at all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from prospectra.llm import periodic_runs as P


def brute(words):
    """All runs (start, length, period): stretches of places whose word comes again p
    words on, from which periods that are no smallest ones are taken out."""
    n, least = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                least.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in least.items())


def changed(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = changed([w for w in (text or "").encode().split()], doc_id)
    runs = brute(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *row, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def awkward(rng):
    """Word lists with runs of many periods, one in another, side by side and cut off."""
    out = []
    for _ in range(150):
        words, size = [], rng.choice((2, 3, 50))
        for _ in range(rng.randint(1, 6)):
            block = [str(rng.randrange(size)) for _ in range(rng.choice((1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33)))]
            if rng.random() < 0.4:
                block = block * rng.randint(2, 4) + [str(rng.randrange(size))]
            words += (block * rng.randint(1, 9))[rng.randint(0, 3) :]
        out.append(words)
    return out


def got(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_fragments_of_tiles_are_whole_runs():
    rng = random.Random(3)
    for words in awkward(rng):
        codes = P.np.array([int(w) for w in words], P.np.int32)
        found = set()
        for k, first, last, data in P._tile_rows(codes):
            p_end, base = 2 << k, max(0, (first - 1) * (2 << k))
            part = P.np.frombuffer(data, "<i4").tolist()
            for c in range(first * p_end - base, last * p_end - base + 1, p_end):
                for p, s, e in P.tile_fragments(part, c, p_end):
                    assert all(words[base + x] == words[base + x + p] for x in range(s, e - p))
                    found.add((p, base + s, base + e))
        for s, n, p in brute(words):
            ends = sorted((a, b) for q, a, b in found if q == p and a >= s and b <= s + n)
            assert ends[0][0] == s and max(b for _, b in ends) == s + n
            assert all(b[0] <= a[1] - p for a, b in zip(ends, ends[1:], strict=False))


def test_runs_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(w) for w in awkward(rng)] + [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "é é é é é é é"]
    rows = [(k, t, "x", 7) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "x", 7), (None, texts[5], "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, period long").repartition(3)
    assert got(P.run_digests(docs)) == sorted(repr(expected(r[0], r[1])) for r in rows)
    plain = sorted((k, *r) for k, t in enumerate(texts) if k != 3 for r in brute((t or "").encode().split()))
    assert sorted(tuple(r) for r in P.find_runs(docs).filter("doc_id is not null and doc_id <> 3").collect()) == plain


def test_a_very_long_text_is_cut_into_many_rows(spark, monkeypatch):
    rng = random.Random(6)
    some = [f"w{rng.randrange(900)}" for _ in range(5000)]
    words = some + some[:700] * 9 + ["z"] * 4000 + some[:2100] * 5 + ["p", "q", "p"] * 30
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "no run in here at all")], "doc_id long, text string")
    monkeypatch.setattr(P, "TILE_WORDS", 256)
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    assert len(list(P._tile_rows(P.np.array([codes[w] for w in words], P.np.int32)))) > 20
    assert got(P.run_digests(docs)) == sorted(repr(expected(k, t)) for k, t in [(1, " ".join(words)), (2, "no run in here at all")])


def test_empty_table_and_given_documents(spark, docs, empty, rows):
    assert P.run_digests(empty).collect() == []
    small = [r for r in rows if len(r[1] or "") < 20_000]
    chosen = docs.filter("coalesce(length(text), 0) < 20000")
    assert got(P.run_digests(chosen)) == sorted(repr(expected(r[0], r[1])) for r in small)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_the_change_of_words(n):
    words = [str(i) for i in range(n)]
    for doc_id in (None, *range(60)):
        assert P.repeated(words, doc_id) == changed(words, doc_id)
