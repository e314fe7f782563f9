import re

import corpus_pipeline
from reelmine.llm import quality, secrets
from reelmine.llm.bpe import _load

from .cases import DATA, documents
from .test_bpe import sha
from .test_decontaminate import brute as contaminated
from .test_near_dup import brute as components


def test_run_against_brute_force(spark):
    """The trained quality stage is taken from its operator; everything after it is computed by brute force."""
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    kept = quality.accepted_rows(docs, quality.train(docs))
    assert 0.7 * docs.count() < kept.count() < docs.count()
    rows = {r.doc_id: r.text for r in kept.collect()}
    comp = {i: c for i, _, _, c in components(list(rows.items()), 5, 80)}
    rows = {i: t for i, t in rows.items() if comp[i] == i}
    bad = {r[0] for r in contaminated(list(rows.items()), [(r.item_id, r.text) for r in bench.collect()]) if r[5]}
    rows = {i: t for i, t in rows.items() if i not in bad}
    ratio = secrets.ratio_table(secrets.pair_counts(spark.createDataFrame(list(rows.items()), "doc_id long, text string")))
    tokenizer, want = _load(None), []
    for i, t in rows.items():
        out, at = "", 0
        for s, _, e in secrets.all_spans(t, ratio)[1]:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        ids = tokenizer.encode(out + t[at:], add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids)))))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(want)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = documents(spark, "words")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_secrets_leave(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    out = corpus_pipeline.secrets_stage(spark, docs, DATA)
    assert out.count() == docs.count()
    assert not any(re.search(r"token = \"[0-9a-f]{32}", r.text) for r in out.collect())
    assert all(len(r.text) == r.n_chars for r in out.limit(50).collect())
