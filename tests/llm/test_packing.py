import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from casework.llm import packing, queries

ODD = ["", "a", " a", "a ", "a  b", "a \n b", "a\n b", "abc\n\n def", "a   b\t c", "it's  'S 's x", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y <|endoftext", "é  b", "x  y", "  ", "\n", "don't you'll  3rd 12 é中文 \U0001f600 b"]


def reference(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, reference(texts), strict=True):
        assert np.frombuffer(enc(text), "<u4").tolist() == ids, text[:100]


def check_pieces(rows, texts_by_id):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    ids = dict(zip(texts_by_id, reference(list(texts_by_id.values())), strict=True))
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        mine, at = [*ids[k], 0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(mine)
            part = mine[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(mine)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / total


def test_query_packs_everything_with_little_padding(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_pieces(queries.op3_packing(spark, sf_dir).collect(), docs) < 0.05


def test_odd_rows(spark):
    voc = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x y z " * 900), (4, "same"), (4, "same"), (None, "q")], "doc_id long, text string")
    rows = packing.pack(docs, voc).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    for r in rows:
        assert r.crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    assert packing.pack(docs.limit(0), voc).count() == 0


def check_plan(h, most=1024):
    """Every rank of every length in one run, its pieces all its ids, sequences gapless; returns the fill."""
    runs, n = packing.plan(h, most)
    placed = defaultdict(list)
    for length, n_docs in h.items():
        at = 0
        for _, k0, k1, pieces in sorted((r for r in runs if r[0] == length), key=lambda r: r[1]):
            assert k0 == at and k1 > k0
            at, done = k1, 0
            for first, offset, start, size in sorted(pieces, key=lambda p: p[2]):
                assert start == done and size > 0 and (start % packing.STEP == 0)
                done += size
                for i in range(k1 - k0):
                    placed[first + i].append((offset, size))
            assert done == length
        assert at == n_docs
    assert set(placed) == set(range(n)) and len(runs) < 12_000
    total = 0
    for pieces in placed.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= most
        total += at
    return total / (most * max(1, n))


def test_plan_uses_every_rank_once():
    rng = np.random.default_rng(1)
    h = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 1024), 300, replace=False), rng.integers(1, 2000, 300), strict=True)}
    h |= {int(k): int(v) for k, v in zip(range(1, 64), rng.integers(1, 3000, 63), strict=True)}
    assert check_plan(h) > 0.99


def test_long_remainders_leave_little_padding():
    rng = np.random.default_rng(2)
    drawn = np.bincount(rng.integers(600, 1024, 20_000))
    assert check_plan({int(k): int(v) for k, v in enumerate(drawn) if v}) > 0.99
    assert check_plan({1023: 5000}) > 0.99 and check_plan({700: 3001}) > 0.99 and check_plan({513: 4000, 1000: 3}) > 0.99
    assert check_plan({7: 1}) < 0.01 and packing.plan({}) == ([], 0)


def test_crc_of_an_end():
    rng = np.random.default_rng(3)
    for n in (1, 4, 33, 5000, 300_000):
        a, b = rng.bytes(77), rng.bytes(n)
        assert packing.crc_of_end(zlib.crc32(a + b), zlib.crc32(a), n) == zlib.crc32(b)


def test_cut_documents_are_whole_again(spark):
    """All remainders over half a window: many are cut, their ids and crcs still add up."""
    docs = {i: "word " * (600 + 7 * i % 400) for i in range(300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    voc = public_tokenizers.path("byte_bpe_50k.json")
    for keep in (True, False):
        rows = packing.pack(df, voc, keep_ids=keep).withColumnsRenamed({"crc32": "ids_crc32", "n_tokens": "doc_tokens"}).collect()
        assert check_pieces(rows, docs) < 0.01 and len(rows) > 1.3 * len(docs)
        assert not keep or all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
