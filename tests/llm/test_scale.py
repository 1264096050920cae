"""Long texts, clashing names, large groups, recall and held-out accuracy."""

import os
import struct
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from prospectra.llm import common, decontaminate, langid, packing, quality_classifier, quality_rules, secrets, simhash, tokens
from pyspark.sql import functions as F

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(*values) -> int:
    """Spark's xxhash64 of texts and ints."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q" if abs(v) >> 31 else "<i", v), seed)
    return _signed(seed)


def test_ratio_and_verdict_equal_brute_force(docs, rows, labels):
    """Every n-gram of every document counted, trusted ones apart; the mean log ratio."""
    trusted = {r.doc_id for r in labels.filter("quality = 1").collect()}

    def grams(text):
        w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text or "").split(" ") if x]
        out = []
        for a, b in zip(w, [*w[1:], None][: len(w)], strict=True):
            pair = _hash(_hash(a), _hash(b), 3) if b is not None else _hash(_hash(a), 3)
            out += [h % quality_rules.BUCKETS for h in (_hash(a), _hash(a[-3:], 1), _hash(a[:3], 2), pair)]
        return out

    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in trusted:
            target.update(grams(r[1]))
    s, n = quality_rules.SMOOTHING, quality_rules.BUCKETS
    total = np.log((sum(raw.values()) + s * n) / (sum(target.values()) + s * n))
    weight = {b: np.log((target[b] + s) / (raw[b] + s)) + total for b in raw}
    found = {r.doc_id: r for r in quality_rules.judge(docs, labels.filter("quality = 1").select("doc_id")).collect()}
    kept = Counter()
    for r in rows:
        g, got = grams(r[1]), found[r[0]]
        if not g:
            assert got.log_ratio is None and not got.kept
            continue
        want = sum(weight[b] for b in g) / len(g)
        assert abs(got.log_ratio - want) < 1e-9
        assert got.kept == (not got.base_failed and want >= quality_rules.THRESHOLD)
        kept[got.kept] += 1
    assert kept[True] and kept[False]


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["the", "of", "Wasser", "HAUS", "x1", "été", "!!", "und", "a\nb", "\n\n", "%%%"]
    texts = [" ".join(rng.choice(words, 900)), "x" * 5000, "one " * 700, "", "日本語のテキスト" * 300, "ends\n", "two words"]
    whole = [simhash.fingerprint(t.encode()) for t in texts]
    assert [simhash.fingerprint(t.encode(), step=64) for t in texts] == whole
    features = quality_classifier.features(pa.array(texts))
    table = np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3).T).astype(np.float32)
    mixed = langid.mixtures(pa.array(texts, pa.large_string()), table)
    monkeypatch.setattr(quality_classifier, "STEP", 100)
    assert np.allclose(quality_classifier.features(pa.array(texts)), features)
    monkeypatch.setattr(langid, "STEP", 100)
    for k in (0, 2, 6):
        assert np.allclose(langid.long_mixture(texts[k].encode(), table), mixed[k], atol=1e-4)
    lines = "\n".join(rng.choice(words, 900)).encode()  # white space, but no space
    assert np.allclose(langid.long_mixture(lines, table), langid.mixtures(pa.array([lines.decode()], pa.large_string()), table)[0], atol=1e-4)


def test_a_document_of_many_languages(spark):
    """No bound on a document's languages but their share."""
    rng = np.random.default_rng(4)
    vocabulary = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for k in range(6)}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    train = [(k, text(lang, 200), lang) for k, lang in enumerate(list(vocabulary) * 5)]
    mixed = " ".join(text(lang, 100) for lang in vocabulary)
    schema = "doc_id long, text string, lang string"
    (got,) = langid.identify(spark.createDataFrame([(1, mixed, None)], schema), spark.createDataFrame(train, schema)).collect()
    assert set(got.proportions) == set(vocabulary) and all(0.1 < v < 0.25 for v in got.proportions.values())


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = langid.held_out(docs).filter("held_out").join(docs.filter("lang is not null and length(text) > 100").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)
    known = labels.filter("quality is not null").select("doc_id", "quality")
    rows = quality_classifier.held_out(docs, labels).filter("held_out").join(known, "doc_id").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    rank = score.argsort().argsort() + 1
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(rows) > 50 and auc > 0.9


@pytest.mark.parametrize("most", [4096, 3])
def test_packing_finds_neighbours_of_all_shards(spark, monkeypatch, most):
    """Of the true BM25 neighbours of the documents whose id is divisible by 100, nine in
    ten lie in the shard of the document, though each shard holds a small part of all; also
    where there are four times as many shards as centres."""
    monkeypatch.setattr(packing, "CENTRES", most)
    rng = np.random.default_rng(6)
    common_words = [f"w{k}" for k in range(60)]
    topics = [["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 5)) for _ in range(40)] for _ in range(12)]
    rows = [(k, " ".join(rng.permutation([*rng.choice(common_words, 40), *rng.choice(topics[k % 12], 40)]))) for k in range(2400)]
    encoded = tokens.encode_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), packing.VOCABULARY, packing.END)
    stored = common.stored(encoded.withColumn("row", F.monotonically_increasing_id()), "test-pack")
    total = stored.agg(F.sum("n_ids")).first()[0]
    placed, shards = packing.placed(stored, total // 12)
    assert 6 <= shards <= 24
    found = sorted((r.doc_id, r.shard, bytes(r.ids)) for r in placed.collect())
    shard = np.array([s for _, s, _ in found])
    size = Counter()
    for _, s, ids in found:
        size[s] += len(ids) // 2
    assert max(size.values()) < 2.2 * total / 12
    index, hits, wanted = packing.Index([np.frombuffer(ids, "<u2") for *_, ids in found]), 0, 0
    for doc in range(0, 2400, 100):
        score = index.scores(doc)
        score[doc] = 0
        near = np.argsort(-score, kind="stable")[:10]
        hits, wanted = hits + int((shard[near] == shard[doc]).sum()), wanted + 10
    assert hits >= 0.9 * wanted


def plain_windows(docs, window):
    """(document, start, length, sequence, offset): a seed, then the unused document that its
    scores put first, until the window is full; what a cut leaves over is the next seed."""
    index, left, out, sequence, at = packing.Index(docs), dict(enumerate(map(len, docs))), [], 0, 0
    seed = None
    while left or at:
        if seed is None:
            if not left:
                break
            seed = doc = min(left)
        else:
            score = index.scores(seed)
            near = [d for d in left if score[d] > 0]
            doc = min(near, key=lambda d: (-score[d], d)) if near else min(left, default=None)
            if doc is None:
                break
            seed = seed if near else doc
        start, n = 0, left.pop(doc)
        while n:
            take = min(n, window - at)
            out.append((doc, start, take, sequence, at))
            start, n, at = start + take, n - take, at + take
            if at == window:
                sequence, at = sequence + 1, 0
        if at == 0:
            seed = None
        elif start > take:
            seed = doc
    return out


def test_windows_equal_a_plain_greedy_fill():
    rng = np.random.default_rng(15)
    for window in (16, 64, 200):
        docs = [np.append(rng.zipf(1.4, int(n)) % 60, 0).astype(np.uint16) for n in rng.integers(0, 70, 150)]
        got = packing.pack_shard(np.array([len(d) for d in docs]), packing._nearest_first(packing.Index(docs)), window)
        assert got == plain_windows(docs, window)


def test_cells_of_copies_are_not_split_for_ever():
    x = np.concatenate([np.eye(128, dtype=np.float32)[[0] * 300], np.eye(128, dtype=np.float32)[1:40]])
    cells = packing.grown(x, np.ones(len(x)), 50)
    leaf, _ = cells.of(x)
    assert len(set(leaf[:300])) == 1 and sorted(cells.leaves()) == np.flatnonzero(cells.child < 0).tolist()


def test_many_copies_spread_over_shards(spark):
    rows = spark.createDataFrame([(1, "the same words in every row " * 20)] * 400 + [(2, "others")], "doc_id long, text string").repartition(3)
    encoded = tokens.encode_table(rows, packing.VOCABULARY, packing.END).withColumn("row", F.monotonically_increasing_id())
    placed, shards = packing.placed(common.stored(encoded, "test-copies"), 5000)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert shards > 5 and max(sizes) < 120
    pieces = packing.pack(rows, shard_ids=5000).collect()
    assert sum(p.length for p in pieces) == placed.selectExpr("sum(length(ids)) / 2").first()[0]


def test_wide_buckets_are_hashed_again(spark):
    """All fingerprints share most bits: every link is found, and rows grow by the masks."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ int(m) for m in rng.integers(0, 1 << 16, 3000)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = simhash.fingerprint_links(df, cell=64, wide=256).collect()
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in found:
        parent[root(r.u)] = root(r.v)
    arr = np.array(prints, np.int64).view(np.uint64)
    for k, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= 4).tolist():
            assert root(p) == root(prints[j])


ITEM = "Why do rivers bend so often when they cross a wide and very flat plain of sand and clay today?"


def test_stages_keep_columns_of_any_name(spark):
    """Names that the operators use inside, with and without underscores, in either case."""
    names = "gone twice times bad found digest _gone _twice _bad _path _digest _FOUND holder raw worded named w h at n k fp component_id x y path rank ids row label score".split()
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    texts = ["the house by the river " * 12, "the house by the river " * 12, f"well {ITEM} then", "my token = abcdef123456 is here", None, ""]
    rows = [(k, t, len(t or ""), *names) for k, t in enumerate(texts)] + [(None, "no id", 5, *names), (3, texts[3], 3, *names)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    for df, want in (
        (quality_classifier.keep_good(docs, labels, 0.0), [-1, 0, 1, 2, 3, 3, 4, 5]), (simhash.keep_one(docs), [-1, 0, 2, 3, 4]),
        (decontaminate.drop_contaminated(docs, bench), [-1, 0, 1, 3, 3, 4, 5]), (secrets.redact(docs), [-1, 0, 1, 2, 3, 3, 4, 5]),
    ):
        assert df.columns == docs.columns and ids(df) == want
        assert all(tuple(r)[3:] == tuple(names) for r in df.collect())
    assert sum(secrets.MASK in (r.text or "") for r in secrets.redact(docs).collect()) == 2
    assert sum(p.length for p in packing.pack(docs).collect()) > 8


def test_scratch_is_removed(spark):
    since = common.marked()
    a, b = common.stored(spark.range(3), "one"), common.stored(spark.range(4), "two")
    common.clear(spark, since, but=1)
    assert b.count() == 4 and common.marked() == since + 1
    with pytest.raises(Exception):
        a.count()
    common.clear(spark, since)



def test_nothing_stays_in_the_shared_folder(spark, docs, labels):
    folder = common.shared_dir(spark).removeprefix("file://")
    before, since = set(os.listdir(folder)), common.marked()
    bench = spark.createDataFrame([(1, "what is the tallest tree")], "item_id long, text string")
    for df in (simhash.keep_one(docs), decontaminate.drop_contaminated(docs, bench), secrets.redact(docs), quality_rules.judge(docs, labels.filter("quality = 1"))):
        df.write.format("noop").mode("overwrite").save()
    assert set(os.listdir(folder)) > before
    common.clear(spark, since)
    assert set(os.listdir(folder)) == before


def test_stages_of_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, empty, str(tmp_path))
        assert got.columns == empty.columns and got.collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
