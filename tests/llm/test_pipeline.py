import corpus_pipeline
import pytest
from conftest_data import SMALL
from kickpool.llm import language, quality_model
from kickpool.llm.common import crc_of, table, written
from kickpool.llm.queries import QUERIES
from test_decontamination import overlaps_by_hand, words
from test_packing import check
from test_simhash import by_hand, groups_by_hand


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_dedup", "decontaminate", "pack"]
    assert QUERIES["pipeline"] is corpus_pipeline.run
    assert {k.split("_")[0] for k in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage at the smallest scale."""
    rows, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(rows)
        rows = written(spark, stage(spark, rows, SMALL), f"test-{name}")
    return [*out, rows]


def test_columns_stay(stages):
    for rows in stages[:-1]:
        assert rows.columns == stages[0].columns


def test_model_stages_keep_what_the_models_say(spark, stages):
    docs = stages[0].collect()
    model = language.train(spark, stages[0].where(crc_of("doc_id") % 4 != 2))
    named, score = model.predict([r.text for r in docs])
    want = {r.doc_id for r, n, s in zip(docs, named, score) if n != "und" and s >= language.MIN_SCORE}
    assert {r.doc_id for r in stages[1].collect()} == want
    docs = stages[1].collect()
    labels = table(spark, SMALL, "labels").where(crc_of("doc_id") % 5 != 0)
    machine = quality_model.train(spark, stages[1], labels)
    score = machine.score([quality_model.slots_of(r.text)[0] for r in docs])
    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r, s in zip(docs, score) if s >= 0.3}


def test_one_of_each_group_stays(stages):
    fps = {r.doc_id: by_hand(r.text) for r in stages[2].collect()}
    label = groups_by_hand(sorted(set(fps.values())))
    first = {}
    for doc_id in sorted(fps):
        first.setdefault(label[fps[doc_id]], doc_id)
    assert {r.doc_id for r in stages[3].collect()} == set(first.values())


def test_contaminated_documents_go(spark, stages):
    items = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    docs = [r for r in stages[3].collect() if r.n_chars < 4000]
    kept = {r.doc_id for r in stages[4].collect()}
    for r in docs:
        have = set(words(r.text))
        leaked = any(len(have & set(words(t))) >= 8 and overlaps_by_hand(r.text, t) for t in items)
        assert (r.doc_id in kept) == (not leaked)


def test_packed_ids(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    assert check(stages[5].collect(), texts) < 0.02


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = written(spark, stage(spark, rows, SMALL), "test-odd")
        assert "sequence_id" in rows.columns
