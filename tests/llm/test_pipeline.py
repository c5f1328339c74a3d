import json

import corpus_pipeline
from tiegrid.llm.queries import WORD_BPE, tokenizer_path

from .conftest import DOCS, sentence


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    item = sentence(900, 25)
    clean = {i: " ".join(f"{w}{(i * 7 + k) % 50}" if k % 3 == 0 else w for k, w in enumerate(sentence(i, 150).split())) for i in range(100, 500)}
    bad = {i: clean[i] + " scummy vile rotten" for i in clean if i % 5 == 0}
    # Half of another document, so that it is no near copy of it.
    half = " ".join(clean[103].split()[:75])
    docs = {**clean, **bad, 600: clean[101], 601: clean[102] + " more", 602: half + " " + item + " after", 603: item, 604: clean[104].replace("a", "o") + " mail x.y@mail.com"}
    labels = [(i, 1, int(i in bad)) for i in clean if i < 450]
    spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in docs.items()], DOCS).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    want = {i: t for i, t in docs.items() if i not in bad and i not in (600, 601, 603)}
    want[602] = half + "  after"
    want[604] = want[604].replace("x.y@mail.com", "[EMAIL]")
    assert set(found) == set(want)
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    for i, t in want.items():
        assert found[i]["ids"] == library.encode(t, add_special_tokens=False).ids, i


def test_stages_keep_the_columns_and_survive_odd_rows(spark, tmp_path, make, odd_rows):
    docs = make(odd_rows).drop("score")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        now = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns, name
                now.write.parquet(out := f"{tmp_path}/{k}-{start is docs}")
                now = spark.read.parquet(out)
        rows = now.collect()
        assert (len(rows) > 0) == (start is docs), json.dumps(len(rows))
