"""Token files and packing against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
from compare import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeflow.llm import packing, token_files, tokens

LIBRARY = Tokenizer.from_file(tokens.default_path())


def direct(text, end):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB.,' \n\t!?éÉß0İ̇Σςǅ<|>endoftx"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_word_by_word_ids_are_the_librarys(texts):
    got = tokens.opened(tokens.default_path()).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_memo_changes_nothing():
    t = tokens.WordTokenizer(tokens.default_path(), memo_words=3)
    for text in ("some words, here. and there", "other words, not here. ends"):
        assert np.frombuffer(t.encode([text.encode()])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_files_hold_every_document(spark, awkward, nothing, tmp_path):
    for df, name in ((awkward, "a"), (spark.read.parquet(f"{SMALL}/documents.parquet"), "b"), (nothing, "c")):
        path = str(tmp_path / name)
        token_files.write_token_files(df, path, tokens.default_path(), 1, 3)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, path).collect())
        want, at = [], 0
        for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
            ids = direct(r["text"], 1)
            want.append((at, r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want


def test_documents_are_read_by_id(spark, awkward, tmp_path):
    path = str(tmp_path / "t")
    least = -(2**63)
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(least, "the least long"), (None, "none")], "doc_id long, text string"))
    token_files.write_token_files(docs, path, tokens.default_path(), 1, 3)
    rows = docs.collect()
    for wanted in ([least], [0], [1, 6, 12_345], []):
        got = sorted((r["doc_id"], r["ids"]) for r in token_files.read_documents(spark, path, wanted).collect())
        assert got == sorted((r[0], direct(r[1], 1).tolist()) for r in rows if r[0] in wanted)
    every = [r["doc_id"] for r in token_files.read_token_files(spark, path).collect()]
    assert every.count(least) == 1 and every.count(None) == sum(r[0] is None for r in rows)


def test_a_sampled_document_trains_from_end_to_end():
    raw = np.arange(50_000, dtype="<u2").tobytes()
    got = token_files.spread(raw)
    assert len(got) == token_files.DICT_SLICES and all(len(s) == token_files.SLICE_BYTES for s in got)
    assert raw.startswith(got[0]) and raw.endswith(got[-1]) and all(raw.find(s) % 2 == 0 for s in got)
    assert token_files.spread(b"") == [] and token_files.spread(raw[:100]) == [raw[:100]]


def test_one_document_is_read_by_its_index(spark, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_token_files(spark.read.parquet(f"{SMALL}/documents.parquet"), path, tokens.default_path(), 1, 2)
    d = spark.read.parquet(f"{path}/dictionary").first()
    block = bytes(spark.read.parquet(f"{path}/blocks").first()["data"])
    r = token_files.BlockReader(block, bytes(d["data"]))
    text = spark.read.parquet(f"{SMALL}/documents.parquet").where(f"doc_id = {r.index['doc_id'][3]}").first()["text"]
    assert r.ids(3).tolist() == direct(text, 1).tolist()
    try:
        token_files.BlockReader(block, bytes(d["data"]) + b"x")
    except ValueError:
        pass
    else:
        raise AssertionError("another dictionary was accepted")


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        window = 64
        pos = [0, *np.cumsum(rng.integers(1, 40, rng.integers(2, 14))).tolist()]
        pen = [int(x) for x in rng.choice([0, 4, 64], len(pos))]
        pad = lambda n: 0 if n & (n - 1) == 0 and n >= 64 else window - n
        best = [0.0] + [np.inf] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                if pos[j] - pos[i] <= window:
                    best[j] = min(best[j], best[i] + pad(pos[j] - pos[i]) + pen[j])
        cuts = packing.best_cuts(pos, pen, window)
        assert cuts[0] == 0 and cuts[-1] == len(pos) - 1
        assert sum(pad(pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:])) == best[-1]


def check_pieces(rows, docs, window):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(direct(r["text"], 2))
    of = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(of) == set(texts)
    for d, pieces in of.items():
        assert sum(p["length"] for p in pieces) == sum(len(t) for t in texts[d])
        for p in pieces:
            assert any(len(t) == p["doc_tokens"] and zlib.crc32(t[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for t in texts[d])
        if len(texts[d]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in (sum(x[1] for x in s) for s in sequences.values()))


def test_packing(spark, awkward, nothing):
    for df, window in ((awkward, 4096), (awkward, 256), (spark.read.parquet(f"{SMALL}/documents.parquet"), 4096)):
        pieces = packing.pack(df, tokens.default_path(), 2, window).collect()
        padding = check_pieces(pieces, df, window)
        total = sum(p["length"] for p in pieces)
        assert padding <= 0.05 * total + 3 * window
    assert packing.pack(nothing, tokens.default_path(), 2).count() == 0


def test_segments_join_without_loss():
    marks = np.zeros(50, bool)
    marks[7] = True
    rng = np.random.default_rng(2)
    p = packing.Packer(marks, 0, 64, 500)
    docs = [rng.integers(0, 49, rng.integers(1, 300)).astype("<u4") for _ in range(60)]
    out = [x for i, d in enumerate(docs) for x in p.add(i, d)] + p.solve(True)
    for i, d in enumerate(docs):
        own = sorted((s, n) for j, s, n, *_ in out if j == i)
        assert [s for s, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) == len(d)
    seqs = [x[5] for x in out]
    assert seqs == sorted(seqs) and set(seqs) == set(range(max(seqs) + 1))


def test_words_of_many_kinds_are_the_librarys():
    """Punctuation after letters, letters that normalizing changes, digits, contractions and empty texts, at once and alone."""
    words = ["osuellí%%%", "abc###", "it's.", "l'été,", "555-6996", "a&&&", "÷ß", "ÿ", "É", "é", "Σας...", "ΟΔΟΣ.", "ﬁn!", "İ.", "中文。", "x" * 300 + "!?", "...", "'s", "a's'", "»hola«", "mañana|", "\x1ca\x1f", "a b", "ö≮"]
    texts = [" ".join(words), "", " \t\n", *words, " ".join(words), "<|endoftext|> " + words[0]]
    for memo in (1_000_000, 0, 40):
        t = tokens.WordTokenizer(tokens.default_path(), memo_words=memo)
        for some in (texts, texts[::-1], [], [""]):
            assert [np.frombuffer(g, "<u4").tolist() for g in t.encode([x.encode() for x in some])] == [LIBRARY.encode(x, add_special_tokens=False).ids for x in some]


def test_words_are_looked_up_once_a_batch():
    """However often a word comes, it is asked for once; punctuation after it is no other word to the library."""

    class Asked(dict):
        def get(self, w, *other):
            asked.append(w)
            return super().get(w, *other)

    asked, t = [], tokens.WordTokenizer(tokens.default_path())
    t.memo = Asked(t.memo)
    direct, t._direct = t._direct, lambda words: sent.extend(words) or direct(words)
    sent: list[bytes] = []
    text = "mañana### the the the word%%% the word mañana. " * 50
    assert np.frombuffer(t.encode([text.encode()] * 3)[1], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted({w.encode() for w in text.split()} | {b""}) and not {w for w in sent if w[:1].isalpha()}


def test_batches_of_words_are_bounded(monkeypatch):
    """Texts go to Arrow a few at a time; the order and the ids stay."""
    texts = [f"word{k} again, {'x' * (k % 50)}." for k in range(60)] + ["", "y " * 400, ""]
    t, sizes = tokens.WordTokenizer(tokens.default_path()), []
    batch, t._batch = t._batch, lambda some: sizes.append(sum(map(len, some))) or batch(some)
    monkeypatch.setattr(tokens, "AT_ONCE", 100)
    assert [np.frombuffer(g, "<u4").tolist() for g in t.encode([x.encode() for x in texts])] == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(x > 100 for x in sizes) == 1 and len(sizes) > 10


def test_packing_holds_one_model(spark):
    """Both ways into the library share one model: a worker's memory isn't taken twice."""
    t = tokens.WordTokenizer(tokens.default_path())
    before = len(t.library.get_vocab())
    assert t.settled.model.__class__ is t.library.model.__class__ and t.settled.get_vocab_size(False) == t.library.get_vocab_size(False) and before >= t.settled.get_vocab_size()
    docs = spark.createDataFrame([(1, "osuellí%%% " * 3000), (2, None), (3, "É. <|ENDOFTEXT|> it's")], "doc_id long, text string")
    check_pieces(packing.pack(docs, tokens.default_path(), 2).collect(), docs, 4096)
