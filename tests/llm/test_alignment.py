"""Token alignment against a plain walk over both token lists."""

import base64
import hashlib
import random
from collections import Counter
from functools import lru_cache

import pytest
from prospectra.llm import alignment as A
from prospectra.llm.tokens import public_path


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path(A.FIRST))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_path(A.SECOND))


def piece_bytes(b, i):
    p = b.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode()


@lru_cache
def ranks_of(path):
    with open(path, "rb") as f:
        return {int(x[1]): base64.b64decode(x[0]) for x in map(bytes.split, f)}


def walk(tools, text):
    """(A ids, B ids, groups of (A ids, B ids), links) of one text."""
    a, b = tools
    none = ([], [], [], [])
    if not text:
        return none
    ranks = ranks_of(public_path("byte_bpe_50k.tiktoken"))
    ids_a, ids_b, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    bytes_a, bytes_b = [ranks[i] for i in ids_a], [piece_bytes(b, i) for i in ids_b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return none
    groups, links, i, j, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
    while i < len(ids_a) or j < len(ids_b):
        if at_a <= at_b and i < len(ids_a):
            ga.append(ids_a[i])
            at_a += len(bytes_a[i])
            i += 1
        else:
            gb.append(ids_b[j])
            at_b += len(bytes_b[j])
            j += 1
        if at_a == at_b and ga and gb:
            groups.append((ga, gb))
            links.append((ga[-1], gb[-1]))
            ga, gb = [], []
    return ids_a, ids_b, groups, links


def expected(tools, rows):
    walked = [walk(tools, t) for _, t in rows]
    count = Counter(x for w in walked for x in w[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for (k, _), (ia, ib, groups, links) in zip(rows, walked, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((k, len(ia), len(ib), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    return sorted(map(repr, out))


ODD = ["<|endoftext|> in a text", "<s> <unk> </s> <0x41>", " leading", "trailing ", "a  b   c", "tab\there\nline\r\n", "\u2581 mark", "日本語 と 😀 العربية", "ﬁ ﬀ é é ¼", "\u3000wide", "\x00 nul \x07", "'s 're don't", "1234567 12 1", "\u200b zero\u200dwidth", "x" * 3000, " ", "  ", "\n"]


def test_against_a_plain_walk(spark, tools):
    rng = random.Random(2)
    chars = "abcdefghij  éß.,;\n\t'0123456789日本▁<|>"
    texts = [*ODD, None, "", *["".join(rng.choice(chars) for _ in range(rng.randint(1, 200))) for _ in range(150)], *[" ".join(rng.choice(("the", "running", "Haus", "naïve", "of")) for _ in range(60)) for _ in range(20)]]
    rows = list(enumerate(texts))
    rows += [rows[3], rows[3], (None, "the running of"), (None, None)]
    docs = spark.createDataFrame([(k, t, 5, "g") for k, t in rows], "doc_id long, text string, links long, pairs string").repartition(3)
    assert sorted(repr(tuple(r)) for r in A.alignment(docs).collect()) == expected(tools, rows)


def test_long_texts_in_parts(tools, monkeypatch):
    rng = random.Random(4)
    vocab = A.vocabularies()
    assert vocab.cuts
    monkeypatch.setattr(A, "PART", 50)
    for _ in range(200):
        text = "".join(rng.choice("abc  e.,1\n\té▁日") for _ in range(rng.randint(60, 700)))
        assert vocab._second(text) == tools[1].encode(text), repr(text)


def test_pairs_are_bounded_by_the_vocabularies(spark, docs):
    vocab = A.vocabularies()
    bound = A.pair_bound(vocab)
    assert bound < 1_000_000
    pairs = A.pair_counts(A.aligned(docs)).select("a", "b").collect()
    assert 0 < len(pairs) <= bound
    for a, b in pairs:
        x, y = vocab.a_tokens[a], vocab.b_tokens[b]
        assert x and y and (x.endswith(y) or y.endswith(x))


def test_steps_and_empty_table(spark, docs, empty, rows, tools, monkeypatch):
    assert A.alignment(empty).collect() == []
    monkeypatch.setattr(A, "STEP", 2000)
    small = [(r[0], r[1]) for r in rows if len(r[1] or "") < 20_000]
    chosen = docs.filter("coalesce(length(text), 0) < 20000")
    assert sorted(repr(tuple(r)) for r in A.alignment(chosen).collect()) == expected(tools, small)
