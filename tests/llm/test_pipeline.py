import re

import corpus_pipeline as C
from larkspur.llm import quality, secret_scan
from tests.llm.test_minhash import brute as near
from tests.llm.test_packing import check_rows

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_items(text, windows, sizes):
    """Text words outside any window, or None if over half is marked."""
    words = [w.encode().lower().decode() for w in WORD.findall(text)]
    hit = {k + j for n in sizes for k in range(len(words) - n + 1)
           if tuple(words[k:k + n]) in windows for j in range(n)}
    if len(hit) > 0.5 * len(words):
        return None
    return [w for k, w in enumerate(words) if k not in hit]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np
    score = model.predict(np.array([quality.statistics(t) for t in rows.values()]))
    want = {d: t for (d, t), s in zip(rows.items(), score) if s >= 0.3}
    step = C.quality_stage(spark, docs, SF)
    assert step.columns == docs.columns
    assert {r.doc_id: r.text for r in step.collect()} == want and len(want) < len(rows)

    kept = {d for d, _, _, keep in near(list(want.items()), 80) if keep}
    want = {d: t for d, t in want.items() if d in kept}
    step = C.dedup_stage(spark, step, SF)
    assert step.columns == docs.columns
    assert {r.doc_id: r.text for r in step.collect()} == want

    items = [WORD.findall(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [[w.encode().lower().decode() for w in i] for i in items if i]
    windows = {tuple(i[k:k + 10]) for i in items for k in range(max(1, len(i) - 9))}
    sizes = {len(w) for w in windows}
    step = C.materialise(C.decontamination_stage(spark, step, SF), "test")
    assert step.columns == docs.columns
    after = {r.doc_id: r.text for r in step.collect()}
    clean = {d: without_items(t, windows, sizes) for d, t in want.items()}
    assert after.keys() == {d for d, w in clean.items() if w is not None}
    for d, t in after.items():
        assert [w.encode().lower().decode() for w in WORD.findall(t)] == clean[d]
    assert any(after.get(d) != t for d, t in want.items())

    step = C.secret_stage(spark, step, SF)
    masked = {r.doc_id: (r.text, r.n_chars) for r in step.collect()}
    assert masked == {d: (secret_scan.mask(t), len(secret_scan.mask(t))) for d, t in after.items()}
    check_rows(C.packing_stage(spark, step, SF).collect(), {d: t for d, (t, _) in masked.items()}, 4096)
