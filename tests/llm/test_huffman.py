import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mixledger.llm import huffman as hf


def texts():
    rnd = random.Random(8)
    bits = ["the", "Der", "étrechê", "it's", "we'll", "9", "2024", "a,b", "###", "\n", "\t", "  ", "   x", " ", " ", "日本", "😀", "<|endoftext|>", "-", "\x1c", "a b", "ñ.\nEr", "\r\n"]
    out = [None, "", " ", "  ", " a", "a ", "a  b", "x" * 3000, "½x²y x½ a²", "é\u0301a x\u0301 \u0301b", "Ünder_score __a a_1", "x\u00a0 y \u2003z", "long words " * 3000]
    for _ in range(120):
        out.append("".join(rnd.choice(bits) + rnd.choice([" ", "", " ", " ", "\n"]) for _ in range(rnd.choice([2, 20, 200]))))
    return out


def check_ids(limit):
    plain = Tokenizer.from_file(public_tokenizers.path(hf.TOKENIZER))
    enc = hf.PieceEncoder(public_tokenizers.path(hf.TOKENIZER), limit)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts()]
    for _ in range(2):  # learning, then from memory
        ids, counts = enc.encode([t or "" for t in texts()])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    return enc


def test_pieces_give_the_ids_of_the_library():
    assert check_ids(hf.CACHE_PIECES).known > 100


def test_memory_is_bounded():
    assert check_ids(50).known <= 50


def huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_lengths_are_optimal_and_limited():
    rnd = np.random.default_rng(1)
    counts = rnd.integers(0, 1000, 500)
    assert int((hf.code_lengths(counts, 20) * counts).sum()) == huffman_cost(counts.tolist())
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    for limit in (4, 5, 12):
        lengths = hf.code_lengths(fib, limit)
        assert lengths.max() <= limit and (2.0 ** -lengths).sum() <= 1
    assert hf.code_lengths(np.array([0, 7]), 5).tolist() == [0, 1]
    assert hf.code_lengths(np.zeros(3, int), 5).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        hf.code_lengths(np.ones(9, int), 3)


def test_blocks_decode_side_by_side():
    rnd = np.random.default_rng(2)
    ids = [rnd.geometric(0.01, n) % 5000 for n in (1, 127, 128, 129, 5000)] + [np.zeros(300, int)]
    counts = np.bincount(np.concatenate(ids), minlength=5000)
    code = hf.Code(hf.code_lengths(counts))
    blocks = [(*code.encode(i), len(i)) for i in ids]
    assert all((a == b).all() for a, b in zip(code.decode(blocks), ids))
    one = hf.Code(hf.code_lengths(np.array([5])))
    assert one.decode([(*one.encode(np.zeros(9, int)), 9)])[0].tolist() == [0] * 9


def test_round_trip(spark, monkeypatch):
    rows = [(i * 3 if i != 4 else None, t, "x", 1) for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], (27, "same id", "x", 1)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n int").repartition(5)
    plain = Tokenizer.from_file(public_tokenizers.path(hf.TOKENIZER))
    got = sorted(hf.round_trip(docs).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted((repr(i), len(x := plain.encode(t or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _, _ in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert hf.round_trip(docs.limit(0)).count() == 0
