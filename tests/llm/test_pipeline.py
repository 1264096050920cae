"""The pipeline, stage by stage and as a whole, against brute force."""

import zlib

import corpus_pipeline
import numpy as np
from prospectra.llm import packing, quality_classifier, secrets, tokens

from tests.llm.test_decontaminate import brute
from tests.llm.test_operators import brute_components, brute_print, brute_secrets

ITEM = "Why do rivers bend so often when they cross a wide and very flat plain of sand and clay today?"


def test_whole_run(spark, docs, rows, labels, tmp_path):
    leaked = spark.createDataFrame([(500, f"the house with water {ITEM} and other things of the mountain table there", "en", "s1", 9, None, None, None, None)], docs.schema)
    docs = docs.unionByName(leaked)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf_dir = str(tmp_path)
    texts = {r[0]: r[1] for r in rows} | {500: leaked.first().text}

    model = quality_classifier.train(docs, labels.filter(~quality_classifier.fold(labels.doc_id)))
    good = {r.doc_id for r in quality_classifier.scores(docs, model).collect() if r.score >= quality_classifier.THRESHOLD}
    roots = brute_components({i: brute_print(texts[i]) for i in good})
    kept = {i for i, r in roots.items() if i == r}
    order = sorted(kept)
    held = {order[k] for k, _ in brute([texts[i] for i in order], [(1, ITEM)])}
    kept -= held
    assert 500 in held or 500 not in good

    at, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns, name
        at.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(sorted({r.doc_id for r in at.select("doc_id").collect()}))
    assert seen == [sorted(good), order, sorted(kept), sorted(kept)]
    final = {r.doc_id: r.text for r in at.collect()}
    for i in kept:
        assert not brute_secrets(final[i])
        if not brute_secrets(texts[i]):
            assert final[i] == texts[i]
        else:
            assert secrets.MASK in final[i]

    enc = tokens.Encoder(tokens.public_path(packing.VOCABULARY))
    ids = {i: np.array([*enc.whole(t or ""), packing.END], "<u4") for i, t in final.items()}
    pieces, total = corpus_pipeline.run(spark, sf_dir).collect(), {}
    for p in pieces:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(v) for i, v in ids.items()}
