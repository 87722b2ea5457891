"""Chat, media, toxicity, language and sampled segmentations: round trips, brute force and held-out accuracy."""

import re
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import SMALL, connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeflow.llm import chat, langid, media, pieces, registry, toxicity
from gaugeflow.llm.common import mix64

TENTH = "/root/testdata/sf0.01"


# ---- chat


def test_another_template_reads_back(spark):
    other = chat.Template(begin="{{go}}", turns={"user": chat.Turn("HUM", " [/HUM]"), "assistant": chat.Turn("BOT", " </turn>", True)}, steps={"start": ("user",), "user": ("assistant",), "assistant": ("user",)})
    said = ["[BOT] hi </s> [/HUM] x", "{{go}}[HUM] a </turn>\\ [\\BOT] <\\/turn>", "", "[ROLE=00] b [/ROLE]"]
    rows = [(1, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(said)] + [(2, 0, "odd role", said[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, other), other).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [r[2:] for r in rows[:4]] and got[1]["loss_text"] == said[1] + said[3]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("odd role", said[0])]



def test_chat_equals_its_sql(spark):
    con = connect(SMALL)
    assert difference(chat.query(spark, SMALL), con, registry.ORACLE_SQL["op4_chat"]) == ""


def test_chat_round_trip_of_hostile_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "[\\INST] \\[/SYS]<s>", "<", "[", "[INST", "INST] ", " [/INST", "", None, "  ", "[ROLE=41] x [/ROLE]", "[\\\\INST]", "</s", "é\n[ASST] \U0001f600 </s>"]
    roles = ["system", "user", "assistant", "tool", "a|b] ", None, ""]
    rows = [(i, k, roles[(i + k) % len(roles)], texts[(i * 3 + k) % len(texts)]) for i in range(20) for k in range(6)] + [(50, None, "user", "x"), (50, 0, "user", "x"), (50, 0, "user", "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("t", F.lit("clash")).withColumn("segments", F.lit(1))
    want = {}
    for c, turn, role, text in rows:
        want.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for r in chat.read_back(chat.format_conversations(df)).collect():
        own = sorted(want.pop(r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in own]
        assert r["loss_text"] == "".join(b for _, a, b in own if a == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert not want
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_turn_order(spark):
    cases = {0: ["system", "user", "assistant", "user"], 1: ["assistant"], 2: ["user", "user"], 3: ["user", "assistant", "system"], 4: ["user"]}
    df = spark.createDataFrame([(c, i, r, "x") for c, rs in cases.items() for i, r in enumerate(rs)], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: (r["valid"], r["first_bad"]) for r in chat.format_conversations(df).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (False, 1), 3: (False, 2), 4: (True, None)}


# ---- media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=3))
def test_clips_are_lossless(texts):
    files = []
    for t in texts:
        frames = np.frombuffer(media.payload(t), np.uint8).reshape(-1, media.FRAME)
        files.append(media.avi(media.encode_frames(frames), len(t)))
    for t, (frames, n) in zip(texts, media.read_frames(files)):
        assert frames.tobytes() == media.payload(t) and n == len(t)


def test_frames_with_every_difference():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 256, (40, media.FRAME), dtype=np.uint8), np.full((2, media.FRAME), 255, np.uint8), np.tile(np.array([0, 255], np.uint8), (2, media.FRAME // 2))])
    lut = media._decode_table(media._PER_LENGTH, media._CATEGORIES)
    assert np.array_equal(media.decode_frames(media.encode_frames(x), lut), x)


def test_file_structure():
    f = media.avi(media.encode_frames(np.zeros((3, media.FRAME), np.uint8)), 5)
    places, micros, n = media.parse(f)
    assert (len(places), micros, n) == (3, media.FRAME_MICROS, 5)
    for at, size in places:
        assert f[at : at + 2] == b"\xff\xd8" and f[at + size - 2 : at + size] == b"\xff\xd9"
        _, lengths, values = media.scan_data(f[at : at + size])
        assert sum(lengths) == len(values) == 9
    with pytest.raises(ValueError):
        media.parse(b"RIFFxxxxWAVE")


def test_shots_adapt():
    still = np.zeros((10, media.FRAME), np.uint8)
    other = np.full((7, media.FRAME), 200, np.uint8)
    assert media.cuts(media.histograms(np.concatenate([still, other, still]))) == [0, 10, 17]
    assert media.cuts(media.histograms(still)) == [0]


def test_media_of_awkward_documents(spark, awkward, nothing):
    files = media.encode_clips(awkward)
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.digest(files).collect())
    want = []
    for r in awkward.select("doc_id", "text").collect():
        t = (r["text"] or "").encode()
        p = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        want.append((r["doc_id"] is not None, r["doc_id"], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want)
    shots = media.clips(files).where("doc_id = 10").orderBy("clip").collect()
    assert shots[0]["start_ms"] == 0 and all(a["end_ms"] == b["start_ms"] for a, b in zip(shots, shots[1:]))
    assert media.digest(media.encode_clips(nothing)).count() == 0


# ---- classifiers


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{TENTH}/labels.parquet")
    got = toxicity.query(spark, TENTH).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean() > 0.8
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.03 * len(neg)
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)


def test_toxicity_scores_against_brute_force(spark):
    """A score is the logistic of the weights of all distinct n-grams of the whole text, added up one by one."""
    full = (1 << 32) - 1

    def buckets(text):
        points, out = [ord(c) for c in " " + re.sub("[\t-\r]", " ", text.lower()) + " "], set()
        for i in range(len(points)):
            h = points[i] * 0x9E3779B1 & full
            for n in range(2, min(5, len(points) - i) + 1):
                h = (h ^ points[i + n - 1]) * 0x85EBCA6B & full
                if n >= 3:
                    out.add((((h ^ h >> 15) * 0xC2B2AE35 + n) & full) >> 12)
        return out

    docs, labels = (spark.read.parquet(f"{TENTH}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    assert weight
    for r in toxicity.score(docs.select("doc_id", "text"), model).collect():
        s = model.intercept + sum(weight.get(b, 0.0) for b in buckets(r["text"] or ""))
        assert abs(r["score"] - 1 / (1 + np.exp(-s))) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    docs, labels = (spark.read.parquet(f"{TENTH}/{t}.parquet") for t in ("documents", "labels"))
    run = lambda d: toxicity.train(d, labels)
    once, thrice = run(docs), run(docs.unionByName(docs).unionByName(docs))
    assert once.buckets.tolist() == thrice.buckets.tolist() and once.weights.tolist() == thrice.weights.tolist()


def test_toxicity_does_not_see_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    run = lambda lab: sorted((r["doc_id"], r["score"]) for r in toxicity.classify(docs, lab).collect())
    assert run(labels) == run(flipped)


def test_toxicity_of_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1), (1, 1), (6, 0), (10, 0), (None, 1), (9, None), (2, 5), (12, 0), (12, 0)], "doc_id long, toxic int")
    got = toxicity.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert len({r["score"] for r in toxicity.classify(awkward, labels.limit(0)).collect()}) == 1
    assert toxicity.classify(nothing, labels).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{TENTH}/documents.parquet")
    got = langid.query(spark, TENTH).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 40").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)


def test_profiles_are_bundles_of_bound_letters(spark):
    text = "Ab cab"
    letters = [langid.letter_ids()[ord(c)] if c.isalpha() else 0 for c in text.lower()]  # no gap after the last word
    want = np.zeros(64)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        va, vb, vc = (langid.letter_vector(int(x), 64).astype(int) for x in (a, b, c))
        want += np.roll(va, 2) * np.roll(vb, 1) * vc
    langs, protos = langid.prototypes(spark.createDataFrame([(text, "xx"), (text, "xx"), (None, "xx"), (text, None)], "text string, lang string"), 64)
    assert langs == ["xx"] and np.array_equal(protos[0], 2 * want)


def test_language_of_awkward_documents(spark, awkward, nothing):
    got = {}
    for r in langid.identify(awkward).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    for i in (3, 4, 5, 8, 11):
        assert got[i] == [("und", 0.0)]
    assert got[0] == got[1] and all(0 <= s <= 1 for v in got.values() for _, s in v)
    assert langid.identify(nothing).count() == 0


# ---- sampled segmentations


def every_path(vocab, chunk):
    lat, out = pieces.Lattices(vocab, [chunk]), {}

    def go(pos, ids, logp):
        for e in range(int(lat.first[pos]), int(lat.first[pos] + lat.count[pos])):
            a, p = [*ids, int(lat.id[e])], logp + float(lat.logp[e])
            if lat.last[e]:
                out[tuple(a)] = p
            else:
                go(int(lat.next[e]), a, p)

    go(0, [], 0.0)
    return out


@pytest.fixture(scope="module")
def flat():
    """A vocabulary whose pieces are nearly equally likely, so that samples spread."""
    v = pieces.Vocabulary(pieces.default_path())
    v.logp = np.full(v.size, -1.0)
    return v


def test_lattice_sums_to_one_and_is_unigram(flat):
    for v in (pieces.vocabulary(pieces.default_path()), flat):
        p = every_path(v, pieces.SPACE + "thing")
        assert abs(sum(np.exp(list(p.values()))) - 1) < 1e-9
        some = list(p)
        weight = {s: sum(v.logp[i] for i in s) for s in some}
        assert max(abs((p[a] - p[some[0]]) - (weight[a] - weight[some[0]])) for a in some) < 1e-9


def test_samples_are_gumbel_top_k(flat):
    n, k, text = 6000, 3, b"an in"
    a, b = (every_path(flat, pieces.SPACE + w) for w in ("an", "in"))
    p = {x + y: np.exp(a[x] + b[y]) for x in a for y in b}
    first, pairs, total = Counter(), Counter(), 0.0
    for s in pieces.sample_texts(flat, [text] * n, mix64(np.arange(1, n + 1, dtype=np.uint64)), k):
        keys = [tuple(x[0].tolist()) for x in s]
        assert len(set(keys)) == k and set(keys) <= set(p)
        first[keys[0]] += 1
        pairs[keys[0], keys[1]] += 1
        total += sum(np.exp(x[1] - x[2]) for x in s)
    err = lambda q: 4.5 * np.sqrt(q * (1 - q) / n) + 1e-3
    assert all(abs(first[x] / n - q) < err(q) for x, q in p.items())
    for x in p:
        for y in p:
            q = p[x] * p[y] / (1 - p[x]) if x != y else 0.0
            assert abs(pairs[x, y] / n - q) < err(q)
    assert abs(total / n - 1) < 0.05


def test_fewer_segmentations_than_samples(flat):
    (s,) = pieces.sample_texts(flat, [b"z"], np.array([5], np.uint64), 50)
    assert len(s) == len(every_path(flat, pieces.SPACE + "z")) and all(x[2] == 0.0 for x in s)


def test_awkward_texts_decode_to_themselves(spark, awkward, nothing):
    path = pieces.default_path()
    got = {}
    for r in pieces.encode_sampled(awkward, path, 3).collect():
        got.setdefault((r["doc_id"], r["decoded_crc32"]), []).append((r["rank"], r["ids_crc32"]))
    want = {(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in awkward.select("doc_id", "text").collect()}
    assert set(got) == want
    assert got[4, 0] == [(0, 0)]
    assert len({c for _, c in got[0, next(c for d, c in want if d == 0)]}) == 3
    again = sorted((r["doc_id"] or 0, r["rank"], r["ids_crc32"], r["log_prob"]) for r in pieces.encode_sampled(awkward.repartition(5), path, 3).collect())
    assert again == sorted((r["doc_id"] or 0, r["rank"], r["ids_crc32"], r["log_prob"]) for r in pieces.encode_sampled(awkward, path, 3).collect())
    assert pieces.encode_sampled(nothing, path).count() == 0


def test_ids_come_out_and_decode_to_their_text(spark, awkward):
    path = pieces.default_path()
    got = pieces.encode_sampled(awkward, path, 3)
    for r in got.collect():
        assert len(r["ids"]) == r["n_ids"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    back = pieces.decode_ids(got.select("doc_id", "rank", "ids"), path)
    assert back.columns == ["doc_id", "rank", "ids", "text"]
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(r["doc_id"], r["text"] or "") for r in awkward.select("doc_id", "text").collect()}
    odd = pieces.decode_ids(spark.createDataFrame([(None,), ([],)], "ids array<int>"), path).collect()
    assert [r["text"] for r in odd] == [None, ""]
