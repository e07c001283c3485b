"""The pipeline's near-duplicate stage links from similarity 0.80 on."""

import pytest

from tidemark.llm import minhash


def test_stage_links_from_080(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(204)]
    near = [*words[:100], *[f"x{i}" for i in range(16)], *words[116:]]  # 200 sets each, 180 common, 220 in all: 0.818
    far = [f"v{i}" for i in range(204)]
    apart = [*far[:100], *[f"y{i}" for i in range(22)], *far[122:]]  # 174 common of 226: 0.770
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, near, far, apart), 1)], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, df, data).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in minhash.mark(df).where("kept").collect()) == [1, 2, 3, 4]
