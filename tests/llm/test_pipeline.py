import re

from test_packing import check
from test_simhash import alike, brute, brute_planes, near_copies, shingle_set

import corpus_pipeline
from cellspan.llm import exact_dedup, language_id, quality, simhash


def test_stages_match_brute_force(spark, sf_dir, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "language ID", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    want = {r.doc_id for r in quality.classify(docs).collect() if r.kept}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    known = stages["language ID"](spark, good, sf_dir).cache()
    model = language_id.fit(good)
    for r in good.collect():
        names, scores = model.predict_batch([language_id.clean(r.text)])
        assert (names[0] != "und" and scores[0] >= language_id.LEAST_SCORE) == bool(known.where(known.doc_id == r.doc_id).isEmpty() is False)
    single = stages["exact dedup"](spark, known, sf_dir).cache()
    least = {}
    for r in known.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    apart = stages["SimHash near-dedup"](spark, single, sf_dir).cache()
    rows = single.collect()
    ids = [r.doc_id for r in rows]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(brute([shingle_set(r.text) for r in rows], ids, alike)))
    assert apart.columns == docs.columns
    bins, at_least = check(apart, stages["best-fit packing"](spark, apart, sf_dir).collect())
    assert bins <= 1.03 * at_least + 1


def test_run_is_the_chain_of_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100


def test_edges_pass_all_stages(spark, sf_dir, edge, empty):
    for df in (edge, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns
            out.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)
        assert packed.where("piece = 0").count() == df.count()


def test_one_of_each_picks_one_of_equal_rows(edge):
    found = simhash.one_of_each(edge).collect()
    rows = edge.collect()
    prints = [brute_planes(r.text) for r in rows]
    groups = len(set(brute(prints, list(range(len(rows))), near_copies)))
    assert len(found) == groups
    assert sum(r.doc_id == 4 for r in found) <= 1
    deduped = exact_dedup.deduplicate(edge)
    assert deduped.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows})


def test_near_dedup_stage_goes_by_the_share_of_shingles(spark, sf_dir, docs):
    single = exact_dedup.deduplicate(docs).cache()
    rows = single.collect()
    want = sorted(set(brute([shingle_set(r.text) for r in rows], [r.doc_id for r in rows], alike)))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, single, sf_dir).collect()) == want
