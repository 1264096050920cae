"""Models against second implementations in plain Python: mixtures by
expectation-maximisation and the choice of their languages, document statistics, trees."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from prospectra.llm import gbdt, langid, quality_classifier, quality_rules, simhash


def ngram_bucket(gram: bytes) -> int:
    code = 0
    for b in gram:
        code = (code * 257 + b) % 2**32
    return ((code ^ (len(gram) * 0x1F123BB5)) % 2**32 * 0x9E3779B1 % 2**32) >> 17


def plain_mixture(text, table, rounds=langid.ROUNDS, share=langid.LEAST_SHARE):
    """Proportions of the best set of languages: every number of languages is tried."""
    languages = table.shape[1]
    likely = []
    for w in text.lower().split():
        grams = [f" {w} ".encode()[i : i + n] for n in langid.ORDERS for i in range(len(f" {w} ".encode()) - n + 1)]
        logs = [sum(float(table[ngram_bucket(g), k]) for g in grams) / len(langid.ORDERS) for k in range(languages)]
        likely.append([math.exp(x - max(logs)) for x in logs])
    n = len(likely)

    def em(theta, times):
        for _ in range(times):
            new = [0.0] * languages
            for row in likely:
                part = [a * b for a, b in zip(row, theta, strict=True)]
                total = sum(part) + 1e-30
                new = [x + p / total for x, p in zip(new, part, strict=True)]
            theta = [x / n for x in new]
        return theta, sum(math.log(sum(a * b for a, b in zip(row, theta, strict=True)) + 1e-30) for row in likely)

    full, _ = em([1 / languages] * languages, rounds)
    order = sorted(range(languages), key=lambda k: -full[k])
    cost = max(0.5 * math.log(n + 1), share * n)
    best, most = None, -math.inf
    for k in range(1, languages + 1):
        begin = [full[j] + 1e-6 if j in order[:k] else 0.0 for j in range(languages)]
        theta, value = em([x / sum(begin) for x in begin], rounds if k > 1 else 0)
        if value - k * cost > most:
            best, most = theta, value - k * cost
    return best


def table_of(vocabularies):
    counts = np.full((langid.BUCKETS, len(vocabularies)), langid.SMOOTHING)
    for k, words in enumerate(vocabularies):
        for w in words:
            for n in langid.ORDERS:
                framed = f" {w} ".encode()
                for i in range(len(framed) - n + 1):
                    counts[ngram_bucket(framed[i : i + n]), k] += 1
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def vocabularies(rng, k):
    letters = ["aeioubcd", "aeioxyzw", "mnpqrstu", "àéîßöüçñ", "efghijkl"]
    return [["".join(rng.choice(letters[j]) for _ in range(rng.randint(2, 7))) for _ in range(120)] for j in range(k)]


def test_mixtures_equal_plain_expectation_maximisation():
    rng = random.Random(8)
    words = vocabularies(rng, 4)
    table = table_of(words)
    texts = []
    for _ in range(60):
        share = [rng.random() ** 3 for _ in words]
        texts.append(" ".join(rng.choice(rng.choices(words, share)[0]) for _ in range(rng.randint(1, 150))))
    got = langid.mixtures(pa.array(texts, pa.large_string()), table)
    for t, row in zip(texts, got, strict=True):
        want = plain_mixture(t, table)
        assert np.allclose(row, want, atol=2e-3), (t, row, want)
        assert np.allclose(langid.long_mixture(t.encode(), table), row, atol=2e-3)


def test_the_penalty_alone_decides_on_a_small_share():
    rng = random.Random(9)
    words = vocabularies(rng, 5)
    table = table_of(words)
    text = [rng.choice(words[0]) for _ in range(9860)] + [rng.choice(words[2]) for _ in range(140)]
    rng.shuffle(text)
    row = langid.mixtures(pa.array([" ".join(text)], pa.large_string()), table)[0]
    assert set(np.flatnonzero(row)) == {0, 2} and row[2] == pytest.approx(0.014, abs=0.004)


def plain_features(text: str) -> dict[str, float]:
    data = text.encode()
    kinds = Counter()
    for b in data:
        c = chr(b)
        kinds["high" if b > 127 else "newline" if c == "\n" else "space" if c in " \t\r\v\f" else "upper" if c.isupper() else "digit" if c.isdigit() else "punct" if c in ".,;:!?'\"()-" else "lower" if c.islower() else "symbol"] += 1
    size = max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    lengths = [len(w.encode()) for w in words]
    mean = sum(lengths) / n
    lines = [x for x in text.split("\n") if x]
    out = {k: kinds[k] / size for k in ("upper", "digit", "punct", "symbol", "high", "space", "newline")}
    out["log_bytes"], out["log_words"] = math.log1p(len(data)), math.log1p(len(words))
    out["word_bytes"], out["word_bytes_sd"] = mean, math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean**2))
    out["longest_word"] = math.log1p(max(lengths, default=0))
    out["entropy"] = -sum(v / size * math.log2(v / size) for v in Counter(data).values())
    out["distinct_words"], out["top_word"] = len(set(words)) / n, max(Counter(words).values(), default=0) / n
    out["repeated_next"] = sum(a == b for a, b in itertools.pairwise(words)) / n
    out["distinct_lines"], out["line_words"] = len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines))
    upper = lambda w: sum(c.isupper() for c in w) > 1 and not any(c.islower() for c in w)
    out["upper_words"] = sum(map(upper, words)) / n
    out["symbol_words"] = sum(any(c in "#*$%&|<>@{}[]\\/=+~^_" for c in w) or "!!" in w or "??" in w for w in words) / n
    out["alpha_words"] = sum(bool(w.rstrip(".,;:!?")) and w.rstrip(".,;:!?").isalpha() and len(w) - len(w.rstrip(".,;:!?")) < 2 for w in words) / n
    out["stop_words"] = sum(w.lower() in quality_classifier.STOP.split() for w in words) / n
    return out


def test_statistics_equal_a_plain_count():
    rng = random.Random(10)
    pieces = ["the", "The", "und", "HAUS", "NATO", "x1", "été", "!!", "what??", "a=b", "#tag", "\n", "\n\n", "\t", "end.", "12,5", "(so)", "Ünder", "w" * 40]
    texts = ["", "a", " ", "\n", *[" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 80))) for _ in range(80)]]
    got = quality_classifier.features(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        want = plain_features(t)
        for name, v in zip(quality_classifier.FEATURES, row, strict=True):
            assert v == pytest.approx(want[name], abs=1e-9), (name, t)


def test_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, (300, 5)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 4)).astype(float)
    m = gbdt.fit(x, y, trees=12, depth=3)

    def walk(row):
        total = m.base
        for feature, cut, leaf in zip(m.feature, m.cut, m.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(m.raw(x), [walk(r) for r in x])
    first = gbdt.fit(x, y, trees=1, depth=1, bins=64)
    base = math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))
    p = 1 / (1 + math.exp(-base))
    gain = {}
    for j in range(5):
        for c in np.unique(x[:, j])[:-1]:
            parts = [(y[s] - p).sum() ** 2 / (s.sum() * p * (1 - p) + 1.0) for s in (x[:, j] <= c, x[:, j] > c)]
            gain[j, c] = sum(parts)
    best = max(gain, key=lambda k: (round(gain[k], 9), -k[0], -k[1]))
    assert (first.feature[0, 0], first.cut[0, 0]) == best


def test_one_row_of_an_id_is_learned_from(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("7L AS doc_id", "concat('copy ', id) AS text").unionByName(spark.range(40).selectExpr("100 + id AS doc_id", "concat('text ', id) AS text"))
    labels = spark.createDataFrame([(7, 1), *[(100 + k, k % 2) for k in range(40)]], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(gbdt, "fit", lambda x, y: seen.append(len(y)))
    quality_classifier.train(docs, labels, rows=100)
    assert seen == [41]


def test_trusted_counts_do_not_depend_on_how_they_meet(spark, docs, labels, monkeypatch):
    target = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumnRenamed("doc_id", "_trusted")
    n = target.count()
    small = sorted(map(tuple, quality_rules.gram_counts(docs, target, n).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_TRUSTED", 0)
    assert sorted(map(tuple, quality_rules.gram_counts(docs, target, n).collect())) == small and small


def test_one_row_of_each_group_stays_though_ids_be_null(spark):
    rng = random.Random(12)
    prose = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    a, b, c = prose(), prose(), prose()
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, c), (None, None), (9, ""), (None, " ")]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, gone_id int").repartition(3)
    left = simhash.keep_one(docs)
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert left.columns == docs.columns and got == sorted([(1, a), (None, b), (3, c), (9, "")], key=str)
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_words_are_rows_before_they_are_hashed(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    rows = quality_rules._gram_rows(docs)
    assert rows.count() == 3 * quality_rules.GRAMS_PER_WORD
    assert "inline(arrays_zip(" in rows._jdf.queryExecution().optimizedPlan().toString()
    words = [f"w{k}" for k in range(9)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:8] * 2)), (3, " ".join(["w"] * 9)), (4, " ".join(words[:8] + ["x"] + words[:7] + ["y"]))]
    found = quality_rules.counts_of(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert [r.n_repeat_words for r in sorted(found, key=lambda r: r.doc_id)] == [0, 16, 9, 0]
