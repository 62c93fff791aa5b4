"""Operators 1, 2 and 8: against the libraries' own ids, brute force, and exact round trips."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wayfarer.llm import bitpack, packing, pieces, tokens
from wayfarer.llm.queries import table, vocabulary_file
from wayfarer.llm.tokens import ChunkEncoder

CLASHING = "doc_id long, text string, piece int, n_tokens long, bin long, shard int, start string"
ODD_ROWS = [(5, "b c", 1, 2, 3, 4, "x"), (None, "a", 1, 2, 3, 4, "x"), (2, None, 1, 2, 3, 4, "x"), (3, "", 1, 2, 3, 4, "x"), (5, "b c", 1, 2, 3, 4, "x"), (4, "long é " * 20_000, 1, 2, 3, 4, "x")]
ALPHABET = st.sampled_from("ab sS1\n\t \x1c\x85é́ÉİßΣσ.,-!?|:;<>'\"½²_😀") | st.sampled_from(["<|endoftext|>", "word", "'s", "  "])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,cuts", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cached_chunks_give_the_whole_texts_ids(name, cuts):
    whole, cached = Tokenizer.from_file(vocabulary_file(name)), ChunkEncoder(vocabulary_file(name), cuts, limit=500)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(ALPHABET, max_size=20).map("".join))
    def same(text):
        assert cached.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    same()
    assert cached.encode(None) == b""


@pytest.mark.parametrize("piece,most", [(1 << 20, 10**6), (64, 200), (256, 50)])
@pytest.mark.parametrize("name,cuts", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_batches_give_the_whole_texts_ids(monkeypatch, name, cuts, piece, most):
    """Also with texts over many slices, and with a table that is forgotten again and again."""
    monkeypatch.setattr(tokens, "SLICE", piece)
    monkeypatch.setattr(tokens, "MOST_ENTRIES", most)
    whole, batched, r = Tokenizer.from_file(vocabulary_file(name)), tokens.BatchEncoder(vocabulary_file(name), cuts), random.Random(1)
    plain = [*"abT ,.!\né", "\n\n", "  ", " the", "\nThe", "averyveryverylongwordindeed", "…", "—"]
    odd = [*plain, *"\t\x1c\x85\u0301İßΣσ-?|:;<>'\"½²_😀×÷\x00\u212a\xa0", "<|endoftext|>", "'s"]
    for _ in range(100):
        texts = ["".join(r.choices(plain if r.random() < 0.6 else odd, k=r.randint(0, 40))) if r.random() > 0.05 else None for _ in range(r.randint(0, 30))]
        ids, offsets = batched.encode_with_end(pa.array(["before", *texts])[1:], 7)
        want = [x.ids + [7] for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)] if texts else []
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.randoms())
def test_packed_ids_come_back(width, n, r):
    ids = np.array([r.getrandbits(width) for _ in range(n)], np.uint32)
    data = bitpack.pack(ids, width)
    assert len(data) == -(-n * width // 8)
    assert (bitpack.unpack(data, width, n) == ids).all()


@pytest.mark.parametrize("vocabulary", [3, 1000, 49_408, 70_000])
def test_shards_allow_random_access(vocabulary):
    r = np.random.default_rng(vocabulary)
    docs = [(i if i % 3 else None, r.integers(0, vocabulary, n).astype(np.uint32)) for i, n in enumerate([0, 5, 20_000, 1, 0, 9000])]
    sink = io.BytesIO()
    writer = bitpack.ShardWriter(sink, vocabulary)
    for d in docs:
        writer.add(*d)
    writer.close()
    reader = bitpack.ShardReader(pa.BufferReader(sink.getvalue()))
    assert [(i, s.tolist()) for i, _, s in reader.documents()] == [(i, s.tolist()) for i, s in docs]
    assert reader.document(2).tolist() == docs[2][1].tolist()
    assert reader.ids(8190, 8200).tolist() == np.concatenate([d for _, d in docs])[8190:8200].tolist()


def test_refuses_what_does_not_fit_or_is_damaged():
    with pytest.raises(ValueError):
        bitpack.pack(np.array([8], np.uint32), 3)
    sink = io.BytesIO()
    writer = bitpack.ShardWriter(sink, 100)
    writer.add(1, np.arange(50, dtype=np.uint32))
    writer.close()
    raw = bytearray(sink.getvalue())
    raw[3] ^= 1
    with pytest.raises(ValueError):
        bitpack.ShardReader(pa.BufferReader(bytes(raw))).document(0)


def test_op2_against_the_library(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").toPandas().sort_values("doc_id")
    t = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    want = [x.ids + [1] for x in t.encode_batch(list(docs.text), add_special_tokens=False)]
    manifest = bitpack.write_shards(table(spark, sf, "documents"), vocabulary_file("word_bpe_49k.json"), 49_408, 1)
    rows = bitpack.read_shards(manifest).toPandas().sort_values("doc_id")
    assert list(rows.start) == np.cumsum([0] + [len(x) for x in want])[:-1].tolist()
    assert list(rows.n_tokens) == [len(x) for x in want] and list(rows.ids_crc32) == [crc(x) for x in want]
    some = spark.createDataFrame([(int(r.shard), int(r.place)) for r in rows.iloc[::37].itertuples()], "shard long, place long")
    got = {r.doc_id: r.ids for r in bitpack.read_documents(manifest, some).collect()}
    assert got == {int(i): want[k] for k, i in enumerate(docs.doc_id) if k % 37 == 0}


def test_op2_odd_rows(spark):
    df = spark.createDataFrame(ODD_ROWS, CLASHING)
    run = lambda d: bitpack.read_shards(bitpack.write_shards(d, vocabulary_file("word_bpe_49k.json"), 49_408, 1)).collect()
    rows = sorted(run(df), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 2, 3, 4, 5, 5]
    assert [r.n_tokens for r in rows][1:3] == [1, 1] and rows[4].ids_crc32 == rows[5].ids_crc32
    assert run(df.limit(0)) == []


def test_pieces_of_long_documents():
    assert packing.cut(0, 8) == [(0, 0)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op8_against_the_library(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    t = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    cut = packing.pieces(table(spark, sf, "documents"), vocabulary_file("byte_bpe_50k.json"), 2048, 0)
    rows = packing.pack(cut, 2048).collect()
    for r in rows:
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids + [0]
        assert crc(ids[r.start : r.start + r.length]) == r.ids_crc32
        assert (r.start, r.length) == packing.cut(len(ids), 2048)[r.piece]
    total = sum(r.length for r in rows)
    assert check_packing(rows, 2048) <= -(-total // 2048) + 1


def test_packing_in_many_rounds_stays_tight(spark):
    r = random.Random(4)
    rows = [(i, 0, 0, min(100, max(1, int(r.expovariate(1 / 20)))), i) for i in range(4000)]
    cut = spark.createDataFrame(rows, packing.PIECE)
    got = packing.pack(cut, 100, nearly=0, per_task=300).collect()
    assert sorted(x.doc_id for x in got) == list(range(4000))
    assert check_packing(got, 100) <= 1.02 * sum(x[3] for x in rows) / 100 + 4


def test_packing_what_never_fits_together(spark):
    cut = spark.createDataFrame([(i, 0, 0, 60, 1) for i in range(900)], packing.PIECE)
    assert check_packing(packing.pack(cut, 100, per_task=200).collect(), 100) == 900


def test_op8_odd_rows(spark):
    df = spark.createDataFrame(ODD_ROWS, CLASHING)
    rows = packing.pack(packing.pieces(df, vocabulary_file("byte_bpe_50k.json"), 2048, 0), 2048).collect()
    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == [2, 3, 4, 5]
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 5 for r in rows) == 2
    check_packing(rows, 2048)
    assert packing.pack(packing.pieces(df.limit(0), vocabulary_file("byte_bpe_50k.json"), 2048, 0), 2048).collect() == []


def all_ways(m, text):
    found = []

    def go(i, score, ids):
        if i == len(text):
            found.append((score, ids))
            return
        for j in range(i + 1, min(len(text), i + m.longest) + 1):
            if (hit := m.pieces.get(text[i:j])) is not None:
                go(j, score + hit[1], (*ids, hit[0]))
        if text[i] not in m.pieces:
            raw = text[i].encode()
            go(i + 1, score + m.byte_score * len(raw), ids + tuple(m.byte_ids[b] for b in raw))

    go(0, 0, ())
    return sorted(found, key=lambda x: -x[0])


def test_n_best_against_all_segmentations():
    m, r = pieces.model(vocabulary_file("piece_bpe_32k.model")), random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab th enr,.\n  é😀") for _ in range(r.randint(1, 10)))
        got = m.best(text, 6)
        ways = all_ways(m, m.normalize(text))
        score = {ids: s for s, ids in ways}
        ids = [tuple(np.frombuffer(b, "<u4").tolist()) for _, b in got]
        assert [round(s * pieces.UNIT) for s, _ in got] == [s for s, _ in ways[:6]]
        assert len(set(ids)) == len(ids) and all(score[i] == round(s * pieces.UNIT) for i, (s, _) in zip(ids, got))
        assert m.best(text, 1) == got[:1]
        assert m.decode(got[0][1]) == m.normalize(text).removeprefix(" ")
        head = m.viterbi(m.normalize(text))
        assert head[0] == ways[0][0] and head[1] == m.lattice_best(m.normalize(text), 2)[0][1]
        assert head[2] == (ways[0][0] - ways[1][0] if len(ways) > 1 else pieces._NEVER)


def test_op1_whole_texts_come_back(spark, sf):
    path = vocabulary_file("piece_bpe_32k.model")
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert back == texts
    for r in pieces.digest(docs, path, 4).collect():
        assert r.decoded and r.scores == sorted(r.scores, reverse=True) and len(set(r.ids_crc32)) == len(r.ids_crc32)


def test_op1_odd_rows(spark):
    df, path = spark.createDataFrame(ODD_ROWS, CLASHING), vocabulary_file("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in pieces.digest(df, path, 4).collect()}
    assert rows[2].n_pieces == rows[3].n_pieces == [0] and rows[2].scores == [0.0] and all(r.decoded for r in rows.values())
    assert pieces.digest(df.limit(0), path, 4).collect() == [] and pieces.encode(df, path, 2).filter("doc_id = 2").count() == 1
    m = pieces.model(path)
    assert len(m.best("ab" * 30_000, 4)) == 4  # one chunk without white space, many ties
