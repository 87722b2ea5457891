"""op10: whole segmentations come out, whatever a worker has met before."""

import zlib

import numpy as np

from gaugeflow.llm import pieces, registry
from gaugeflow.llm.common import mix64

SMALL = "/root/testdata/sf0.001"


def test_query_returns_every_id_and_they_decode_to_the_texts(spark):
    got = registry.QUERIES["op10_pieces"](spark, SMALL)
    assert got.columns == ["doc_id", "rank", "ids", "n_ids", "ids_crc32", "log_prob", "log_inclusion", "decoded_crc32"]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    back = pieces.decode_ids(got, pieces.default_path()).collect()
    assert {r["doc_id"] for r in back} == set(texts)
    for r in back:
        assert r["text"] == texts[r["doc_id"]] and zlib.crc32(r["text"].encode()) == r["decoded_crc32"]
        assert len(r["ids"]) == r["n_ids"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def rows_of(vocab, texts, seeds):
    return [[(s.tolist(), logp, log_q) for s, logp, log_q in x] for x in pieces.sample_texts(vocab, texts, seeds, 3)]


def test_draws_do_not_depend_on_the_texts_beside(spark):
    """All texts at once, in short batches, backwards and each alone: the same segmentations, to the last digit."""
    texts = [("word%d some words again é \n漢字 " % (i % 7) * (1 + i % 3)).encode() for i in range(40)] + [b"", b" "]
    seeds = mix64(np.arange(len(texts), dtype=np.uint64))
    vocab = pieces.vocabulary(pieces.default_path())
    want = rows_of(vocab, texts, seeds)
    for n in (1, 5, 17):
        assert [x for i in range(0, len(texts), n) for x in rows_of(vocab, texts[i : i + n], seeds[i : i + n])] == want
    assert rows_of(vocab, texts[::-1], seeds[::-1]) == want[::-1]


def test_lattice_of_every_piece(spark):
    """The edges of a position are the pieces that start there, or its character's bytes, by size."""
    vocab = pieces.vocabulary(pieces.default_path())
    model = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.default_path())
    text = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    chunks = ["▁international", "▁a", "\n", "▁▁▁▁", "▁\U0001f600x", "▁über", "x" * 200]
    lat = pieces.Lattices(vocab, chunks)
    at = 0
    for c in chunks:
        for i in range(len(c)):
            want = [(n, text[c[i : i + n]]) for n in range(1, len(c) - i + 1) if c[i : i + n] in text]
            if not want or want[0][0] > 1:
                want.insert(0, (1, pieces.FALLBACK + ord(c[i])))
            e = slice(int(lat.first[at + i]), int(lat.first[at + i] + lat.count[at + i]))
            assert list(zip(lat.size[e].tolist(), lat.id[e].tolist())) == want
            assert lat.next[e].tolist() == [at + i + n for n, _ in want] and lat.last[e].tolist() == [i + n == len(c) for n, _ in want]
            assert abs(np.exp(lat.logp[e]).sum() - 1) < 1e-9
        at += len(c)


def test_crc_of_many_runs_is_that_of_each(spark):
    vocab = pieces.vocabulary(pieces.default_path())
    found = [x[0][0] for x in pieces.sample_texts(vocab, [b"a b", b"", b" ", b"  two", "é\U0001f600".encode()], mix64(np.arange(5, dtype=np.uint64)), 1)]
    got = pieces.decoded_crc32(vocab, np.concatenate(found).view(np.int32), np.cumsum([0, *map(len, found)]))
    assert got == [zlib.crc32(pieces.decode(vocab, x)) for x in found]
    assert pieces.decoded_crc32(vocab, np.zeros(0, np.int32), np.array([0, 0, 0])) == [0, 0]
