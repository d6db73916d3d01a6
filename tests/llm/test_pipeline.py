import corpus_pipeline
from partcast.llm import near_duplicates, quality
from partcast.llm.base import materialise

from .util import EDGE, documents, empty, prose

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    text = prose(1, 200)
    rows = EDGE + [(k, prose(k, 200), "ab"[k % 2]) for k in range(10, 60)] + [(70, text), (71, text.title()), (72, text + " one more"), (73, "mail me: x@y.example.com " + prose(9, 90))]
    docs, kept = documents(spark, rows), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "mix_sources", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        docs = kept[name] = materialise(out, name)
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in kept.items()}
    assert ids["quality_rules"] == set(range(10, 60)) | {70, 71, 72, 73}
    assert ids["near_dedup"] == set(range(10, 60)) | {70, 73}
    texts = {r["doc_id"]: r["text"] for r in kept["personal_data"].collect()}
    assert texts[73].startswith("mail me: [EMAIL] ") and texts[10] == prose(10, 200)
    assert ids["best_fit_packing"] == ids["mix_sources"]


def test_run_on_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_an_empty_corpus_passes(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "empty")
    assert docs.count() == 0


def test_quality_then_dedup_uses_the_operators(spark):
    docs = documents(spark, [(k, prose(k % 3, 100)) for k in range(9)])
    assert sorted(r["doc_id"] for r in near_duplicates.keep(quality.keep(docs)).collect()) == [0, 1, 2]
