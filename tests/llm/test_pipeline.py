import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_mixing import check
from tests.llm.test_neardup import brute as classes
from tests.llm.test_packing import check_pieces
from tests.llm.test_pii import brute as spans

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen[name] = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert name == "packing" or docs.columns == columns
    seen["end"] = docs.collect()
    # quality: labelled documents
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["near_dedup"]}
    good = [r.doc_id in kept for r in seen["quality"] if quality.get(r.doc_id) == 1]
    bad = [r.doc_id in kept for r in seen["quality"] if quality.get(r.doc_id) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    # near-duplicates: one of each class
    want = {k for k, _, c, stays in classes([(r.doc_id, r.text) for r in seen["near_dedup"]], 5) if stays}
    assert Counter(r.doc_id for r in seen["pii"]) == Counter(want)
    # personal data
    before = {r.doc_id: r.text for r in seen["pii"]}
    for r in seen["mixing"]:
        assert not spans(r.text) and r.n_chars == len(r.text)
        if not re.search(r"[0-9@]|://", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    # mixing
    times = Counter(r.doc_id for r in seen["packing"])
    words = {r.doc_id: len(r.text.split()) for r in seen["mixing"]}

    class Row(dict):
        __getattr__ = dict.__getitem__

    sizes = Counter()
    for r in seen["mixing"]:
        sizes[r.source] += words[r.doc_id]
    from tests.llm.test_mixing import brute_targets

    target = brute_targets(dict(sizes))
    off = check([Row(doc_id=r.doc_id, size=words[r.doc_id], source_size=sizes[r.source], target=target[r.source], taken=times[r.doc_id] * words[r.doc_id]) for r in seen["mixing"]], seen["mixing"])
    assert max(off.values()) <= max(words.values())
    # packing: each row of a repeated document is packed; its rows may be cut at different places
    texts, pieces, ends, copies = {}, [], {}, Counter()
    for r in seen["packing"]:
        texts[(r.doc_id, len([k for k in texts if k[0] == r.doc_id]))] = r.text
    for r in sorted(seen["end"], key=lambda r: (r.doc_id, r.start, r.sequence_id, r.offset)):
        if r.start == 0:
            copy, copies[r.doc_id] = copies[r.doc_id], copies[r.doc_id] + 1
        else:  # goes on where a copy has ended so far
            copy = ends[(r.doc_id, r.start)].pop()
        ends.setdefault((r.doc_id, r.start + r.length), []).append(copy)
        pieces.append(Row(doc_id=(r.doc_id, copy), start=r.start, length=r.length, ids_crc32=r.crc32, doc_tokens=r.n_tokens, sequence_id=r.sequence_id, offset=r.offset))
    assert copies == times
    assert check_pieces(pieces, texts) < 0.05


def test_run_gives_the_same_rows(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(a.columns)
