"""Packing over several cells: numbers of sequences stay apart and beyond 32 bits, every piece is placed once, gapless."""

from collections import defaultdict

from sylva.llm import packing, tokens


def test_cells(spark):
    texts = [" ".join(f"word{(i * 7 + j) % 90}" for j in range(i % 40)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = packing.pack(docs, 64, tokens.default_path(), cell=10).collect()
    code, bins = tokens.encoder(tokens.default_path()), defaultdict(list)
    want = {(i, k): min(64, len(code.encode(t)) // 4 + 1 - 64 * k) for i, t in enumerate(texts) for k in range(-(-(len(code.encode(t)) // 4 + 1) // 64))}
    assert {(r.doc_id, r.piece): r.length for r in got} == want and len(got) == len(want)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert max(bins) > 1 << 32
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
