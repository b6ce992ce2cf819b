"""The pipeline's stages, one after the other, on a table with planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from tessel.llm._store import Workspace


def test_stages(spark, tmp_path):
    r = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n=120: [vocabulary[i] for i in r.integers(0, 3000, n)]
    item = [f"b{i}" for i in range(30)]
    rows, toxic, leaks = [], set(), set()
    for i in range(300):
        w = prose()
        if i % 10 == 3:
            w[10:10], w[50:50] = ["trashy"], ["trashy"]
            toxic.add(i)
        elif i % 25 == 7:
            w[30:30] = item
            leaks.add(i)
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1, "x"))
    copies = {i + 1000: i for i in range(0, 60, 6) if i not in toxic | leaks}
    rows += [(k, rows[i][1] + " tail", "en", "s0", 1, "x") for k, i in copies.items()]
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "s1", 0, "x"), (2002, "", "en", "s1", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(300)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ws, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), Workspace(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.save(stage(spark, docs, str(tmp_path)), name)
        got[name] = [x["doc_id"] for x in docs.select("doc_id").collect()]
        if name != "token_files":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    every = {x[0] for x in rows}
    assert set(got["toxicity"]) == every - toxic
    assert set(got["ngram_jaccard"]) == every - toxic - set(copies)
    assert set(got["decontamination"]) == every - toxic - set(copies) - leaks
    assert {2000, 2001, 2002} <= set(got["mixing"]) <= set(got["decontamination"])
    assert sorted(got["token_files"]) == sorted(got["mixing"])
    starts = docs.orderBy("start").select("doc_id", "start", "n_tokens").collect()
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(starts, starts[1:]))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] == sum(x["n_tokens"] for x in starts)
