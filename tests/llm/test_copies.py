"""Near-duplicates of texts, lines and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from compare import SMALL
from awkward_docs import prose
from pyspark.sql import functions as F

from gaugeflow.llm import embeddings, graph, linedup, minhash
from gaugeflow.llm.common import Scratch


def union(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_counts(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def probability_jaccard(x, y):
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def copies(seed, groups, size):
    """Groups of edited copies and unrelated texts."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = prose(rng, 150).split(" ")
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out + [prose(rng, 100) for _ in range(20)]


def test_classes_are_those_of_brute_force(spark):
    texts = copies(1, 4, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    s = [shingle_counts(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(s)), 2) if len(s[a] & s[b]) and (len(s[a].keys() & s[b].keys()) / len(s[a].keys() | s[b].keys()) >= 0.8 or probability_jaccard(s[a], s[b]) >= 0.8)]
    want = union(len(s), links)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.classes(docs).collect()}
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(want))
    assert all(k == (i == c) for i, (c, k) in got.items())
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == sorted(set(want))


def test_copies_that_repeat_a_passage(spark):
    """One side repeats 20 of its words again and again: J_P falls as far as one likes, the plain Jaccard stays."""
    texts = []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(120)]
        texts += [" ".join(words), " ".join(words[:60] + words[40:60] * (3, 5, 10, 30)[k % 4] + words[60:])]
    s = [shingle_counts(t) for t in texts]
    assert all(len(s[a].keys() & s[a + 1].keys()) >= 0.9 * len(s[a].keys() | s[a + 1].keys()) for a in range(0, 120, 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()} == {i: i // 2 * 2 for i in range(120)}


def test_repeating_copies_in_one_bucket(spark, monkeypatch):
    """The same through blocks: a chain of texts whose links hold by the plain Jaccard alone, in small blocks."""
    monkeypatch.setattr(graph, "BLOCK", 4)
    base, texts = [f"b{i}" for i in range(400)], []
    for k in range(24):
        w = list(base)
        w[k * 12 : k * 12 + 60] = [f"y{k}_{j}" if j % 2 else w[k * 12 + j] for j in range(60)]
        texts += [" ".join(w), " ".join(w[:380] + w[360:380] * 12 + w[380:])]
    s = [shingle_counts(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(s)), 2) if len(s[a].keys() & s[b].keys()) >= 0.8 * len(s[a].keys() | s[b].keys())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert got == dict(enumerate(union(len(s), links)))


def test_a_star_whose_copies_differ_from_each_other(spark):
    """Copies near enough to their source only: the class hangs on the source alone."""
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join(base)]
    for k in range(40):
        w = list(base)
        for j in range(8):
            w[(k * 9 + j * 50) % 400] = f"x{k}_{j}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["class_id"] for r in minhash.classes(docs).collect()} == {0}


def test_similarity_is_the_definition():
    rng = random.Random(3)
    for _ in range(50):
        x, y = (Counter(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 20))) for _ in range(2))
        ids = sorted(set(x) | set(y))
        side = lambda c: (np.array([ids.index(k) for k in sorted(c)], np.uint64), np.array([float(c[k]) for k in sorted(c)]))
        jp, j = minhash.similarity(side(x), side(y))
        assert abs(jp - probability_jaccard(x, y)) < 1e-9 and abs(j - len(x.keys() & y.keys()) / len(ids)) < 1e-12


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 53, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 1 << 53, 60).astype(np.uint64)])
    wa, wb = rng.integers(1, 4, 300).astype(float), np.concatenate([np.ones(200), rng.integers(1, 4, 100)]).astype(float)
    at = np.repeat([0, 1], 300)
    sig = minhash.prob_minhash(2, at, np.concatenate([a, b]), np.concatenate([wa, wb]), 4000)
    order = np.argsort(a), np.argsort(b)
    jp, _ = minhash.similarity((a[order[0]], wa[order[0]]), (b[order[1]], wb[order[1]]))
    assert abs((sig[0] == sig[1]).mean() - jp) < 0.03


def test_awkward_documents(spark, awkward, nothing):
    got = minhash.classes(awkward).collect()
    assert len(got) == awkward.count()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add((r["class_id"], r["kept"]))
    assert of[0] == {(-5, False)} and of[1] == {(-5, False)} and of[2] == {(-5, False)} and of[-5] == {(-5, True)}
    for i in (3, 4, 5, 8):
        assert of[i] == {(i, True)}
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    # of the two equal rows with id 7 one stays, both texts with id 6 stay
    assert [i for n, i in ids if n] == sorted([-5, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11, 12, 13]) and ids[0] == (False, 0)
    assert minhash.classes(nothing).count() == 0 and minhash.keep_one(nothing).count() == 0


def line_sets(line):
    w = linedup.WIDTH
    return {line} if len(line) <= w else {line[i : i + w] for i in range(len(line) - w + 1)}


def cleaned(docs):
    """docs: (doc_id, text), ids distinct."""
    first, order = {}, []
    for i, t in sorted(docs):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip() and line not in first:
                first[line] = (i, p)
                order.append(line)
    s = [line_sets(x) for x in order]
    links = [(a, b) for a, b in combinations(range(len(s)), 2) if (n := len(s[a] & s[b])) and n >= 0.8 * (len(s[a]) + len(s[b]) - n)]
    root = union(len(s), links)
    stay = {}
    for k, line in enumerate(order):
        stay[root[k]] = min(stay.get(root[k], first[line]), first[line])
    at = {line: stay[root[k]] for k, line in enumerate(order)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or at[x] == (i, p)) for i, t in docs}


def test_lines_against_brute_force(spark):
    rng = random.Random(11)
    pool = [prose(rng, 12).replace("\n", " ") for _ in range(25)] + ["http://example.org/" + "a" * 60, "中文文字没有空格可是也要比较的一行内容而且足够长", "short", "Les.", "  ", ""]
    pool += [p[:40] + "#" + p[41:] for p in pool[:12]] + [p + "!" for p in pool[12:27]]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(40)] + [(98, None), (99, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in linedup.clean(df).collect()}
    assert got == cleaned(docs)


def test_short_lines_that_differ_at_an_end(spark):
    """Pairs of short lines over the threshold, edited at either end or within: hardly any is missed, wherever the edit is."""
    rng, docs, want = random.Random(17), [], {}
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for k in range(1600):
        line = " ".join(word(rng.randrange(5, 11)) for _ in range(2 + k % 9))
        if k // 9 % 4 == 0:
            other = line[:-2] + str(rng.randrange(10, 100))
        elif k // 9 % 4 == 1:
            other = str(rng.randrange(10, 100)) + line[2:]
        elif k // 9 % 4 == 2:
            at = rng.randrange(len(line))
            other = line[:at] + "#" + line[at + 1 :]
        else:
            other = line + rng.choice(".!?")
        a, b = line_sets(line), line_sets(other)
        if len(a & b) >= 0.8 * len(a | b):
            docs += [(2 * k, line), (2 * k + 1, other)]
            want[2 * k + 1] = k // 9 % 4
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    gone = {r["doc_id"] for r in linedup.drop_lines(df).collect()}
    assert gone <= set(want)
    for kind in range(4):
        of = [i for i, k in want.items() if k == kind]
        assert len(of) >= 50 and sum(i in gone for i in of) >= 0.97 * len(of), (kind, len(of), sum(i in gone for i in of))


def test_lines_of_awkward_documents(spark, awkward, nothing):
    out = linedup.clean(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert texts[3] == [None] and texts[4] == [""] and texts[8] == ["   \n\t "]
    assert texts[1] == [""] and texts[9] == ["x" * 70_000]
    assert linedup.clean(nothing).count() == 0


def test_line_query_reports_what_is_left(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in cleaned(docs).items()}
    got = {r["doc_id"]: r["kept_sha256"] for r in linedup.query(spark, SMALL).collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = union(500, [(a, b) for a, b in links if a != b])
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df, Scratch(spark)).collect()}
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}


def test_a_crowded_star_loses_no_link(spark):
    """Nodes that are near none but one other of a large star, the lead being near none."""
    n = 4200
    same = F.shiftright("lead", 1) == F.shiftright("node", 1)
    spokes = spark.range(1, n).select(F.lit(0).cast("long").alias("lead"), F.col("id").alias("node"))

    def blocks(dealt):
        x, y = dealt.where("left").alias("x"), dealt.where("right").alias("y")
        of = lambda c: F.col(f"x.{c}") == F.col(f"y.{c}")
        near = F.shiftright(F.col("x.node"), 1) == F.shiftright(F.col("y.node"), 1)
        return x.join(y, of("lead") & of("i") & of("j") & near & (F.col("x.c") != F.col("y.c"))).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))

    score = lambda s: s.select("lead", "node", F.lit(0.0).alias("sim"), same.alias("linked"), F.lit(10).alias("size"))
    found = graph.link_stars(spokes, score, blocks, Scratch(spark))
    assert {r["node"]: r["component"] for r in found.collect()} == {i: i // 2 * 2 for i in range(n)}


def test_recall_of_lines_at_the_threshold(spark):
    """Pairs of long lines planted at a Jaccard of 0.8 to 0.85, from 60 to 2,000 characters."""
    rng, docs = random.Random(23), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    while len(docs) < 1200:
        line = " ".join(word() for _ in range(rng.choice([10, 30, 80, 300])))
        other = list(line)
        for _ in range(rng.randrange(1, 2 + len(line) // 60)):
            other[rng.randrange(len(other))] = rng.choice("#%&")
        other = "".join(other)
        a, b = line_sets(line), line_sets(other)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            docs += [(len(docs), line), (len(docs) + 1, other)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    gone = {r["doc_id"] for r in linedup.drop_lines(df).collect()}
    assert gone <= set(range(1, 1200, 2)) and len(gone) >= 0.95 * 600


def test_lines_that_repeat_themselves(spark):
    """Lines of few distinct shingles, whatever their length."""
    docs = [(0, "-" * 90), (1, "-" * 400), (2, "ab" * 200), (3, "ab" * 3000), (4, "ha" * 30 + "."), (5, "=-" * 5000), (6, "=-" * 60)]
    got = {r["doc_id"]: r["text"] for r in linedup.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == cleaned(docs)


def test_rows_with_one_id_keep_their_own_lines(spark):
    own = "a wholly unique opening line that is not to be found anywhere else"
    docs = [(1, "first line of all texts"), (5, "shared line of the two\nsecond line of the first text"), (5, f"{own}\nanother line, and one of its own too"), (5, f"{own}\nanother line, and one of its own too"), (7, "second line of the first text\nshared line of the two")]
    got = sorted((r["doc_id"], r["text"]) for r in linedup.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([*docs[:4], (7, "")])


@pytest.mark.parametrize("torn", [False, True])
def test_vectors_against_brute_force(spark, monkeypatch, torn):
    if torn:  # different vectors often have one hash
        real = embeddings.node_of
        monkeypatch.setattr(embeddings, "node_of", lambda vec, salt=0: real(vec, salt) if salt else F.pmod(real(vec), F.lit(40)))
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([rng.standard_normal((300, 16)), *(c + 0.12 * np.linalg.norm(c) / 4 * rng.standard_normal((40, 16)) for c in centres)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0] * 3, 1), (2005, [], 1), (2006, (x[5] * 3).tolist(), 1), (2007, x[5].tolist(), 1), (2007, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {(r["vec_id"]): (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.link(df).collect()}
    ids = [r[0] for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    m = np.array([r[1] for r in rows if r[0] in set(ids) and r[1]], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    over = m @ m.T >= 0.9
    root = union(len(ids), list(zip(*np.nonzero(np.triu(over, 1)))))
    want = {i: (int(over[k].sum()) - 1, ids[root[k]]) for k, i in enumerate(ids)}
    right = sum(got[i][:2] == w for i, w in want.items())
    assert right >= 0.98 * len(want)
    assert sum(got[i][0] for i in want) >= 0.97 * sum(w[0] for w in want.values())
    for i in (2000, 2001, 2002, 2003, 2004, 2005):
        assert got[i] == (0, i, True)
    assert embeddings.link(df.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark):
    """Each length is compared within itself; a null id and columns of clashing names do no harm."""
    rng = np.random.default_rng(3)
    rows = []
    for k, d in enumerate((4, 8, 8, 4)):
        v = rng.standard_normal(d)
        rows += [(10 * k + j, (v + 0.01 * rng.standard_normal(d)).tolist(), 0) for j in range(3)]
    rows += [(77, [1.0] * 5, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("node", "vec", "d", "n_links", "kept")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.link(df).collect()}
    m = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    near = lambda a, b: len(m[a]) == len(m[b]) and m[a] @ m[b] >= 0.9
    ids = [i for i in m if i is not None]
    for i in ids:
        links = [j for j in m if j != i and near(i, j)]
        assert got[i][0] == len(links) and got[i][1] == min([i, *(j for j in links if j is not None)])
    assert got[None][:2] == (3, 0) and got[77] == (0, 77, True)


def test_recall_that_stays_low_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAST_RECALL", 1.1)
    df = spark.createDataFrame([(100 * i, [1.0, 0.001 * i]) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(embeddings.RecallTooLow):
        embeddings.link(df)


def test_repeated_characters_beyond_the_first_plane(spark):
    """Lines of two code units a character that repeat themselves, shorter in characters than the positions drawn."""
    a, b = "\U0001f600\U0001f601", "\U0001f602x\U0001f603"
    docs = [(0, a * 25), (1, a * 30), (2, "other words\n" + a * 28), (3, b * 30), (4, b * 40), (5, "\U0001f600" * 20 + "y" * 60)]
    got = {r["doc_id"]: r["text"] for r in linedup.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == cleaned(docs) and got[1] == got[4] == "" and got[2] == "other words"


def test_shingles_are_code_points_and_blank_lines_are_left_out(spark):
    some = ["short", "exactly 10", "eleven char", "é\U0001f600" * 9, "aaaaaaaaaaaaaaa", " \t indented by white space", "\x01control", " no-break space", "x"]
    df = spark.createDataFrame([(k, x + "\n \t\x0b\x0c\r \n") for k, x in enumerate(some)], "doc_id long, text string")
    met = linedup.lines(df)
    assert sorted(r["line"] for r in met.collect()) == sorted(some)
    of = {r["line"]: r["s"] for r in met.select("line", linedup.shingles(F.col("line")).alias("s")).collect()}
    for line, s in of.items():
        assert len(s) == len(set(s)) == len(line_sets(line))
    assert "regexp" not in linedup.shingles(F.col("line"))._jc.toString()
    # a line of one shingle is the shingle of a longer line
    assert of["aaaaaaaaaaaaaaa"] == spark.range(1).select(linedup.shingles(F.lit("a" * 10)).alias("s")).first()["s"]


def test_each_position_is_hashed_once(spark):
    """What passes the bound isn't hashed again, and the bound is worked out once a line, below the positions."""
    df = spark.createDataFrame([(1, "a line of some length, and a few words of it more")], "doc_id long, text string")
    plan = linedup.signatures(linedup.lines(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(substring(") == 1
    assert plan.index("Generate explode(sequence") < plan.index("CASE WHEN (n#")


def test_recall_of_lines_of_other_scripts(spark):
    """Pairs planted at a Jaccard of 0.8 to 0.85 in characters of one to four bytes."""
    rng, docs, kind = random.Random(5), [], {}
    letters = {"latin": "abcdefghijklmnopqrstuvwxyzäöüßéèñ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "han": "".join(chr(0x4E00 + i) for i in range(800)), "emoji": "abcdefghijklmnopqrstuvwxyz"}
    for name, of in letters.items():
        edits = ["\U0001f600", "\U0001f603", "’"] if name == "emoji" else ["é", "Ж", "的", "x"]
        while sum(k == name for k in kind.values()) < 300:
            line = " ".join("".join(rng.choice(of) for _ in range(rng.randrange(2, 9))) for _ in range(rng.choice([8, 15, 40])))
            other = list(line)
            for _ in range(rng.randrange(1, 2 + len(line) // 60)):
                other[rng.randrange(len(other))] = rng.choice(edits)
            other = "".join(other)
            a, b = line_sets(line), line_sets(other)
            if 0.8 <= len(a & b) / len(a | b) <= 0.85:
                kind[len(docs) + 1] = name
                docs += [(len(docs), line), (len(docs) + 1, other)]
    gone = {r["doc_id"] for r in linedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert gone <= set(kind)
    for name in letters:
        assert sum(kind[i] == name for i in gone) >= 0.95 * 300, name


def test_lone_spokes_carry_no_differences(spark):
    """A star of two nodes has nothing left to compare; its similarity is exact all the same."""
    base = "the quick brown fox jumps over the lazy dog and runs away from it"
    texts = [(0, base), (1, base + "!"), (2, "aaaaaaaaaaaaaaaaaaaaaaaaaa"), (3, base), (4, base + "?"), (5, "x" + base)]
    df = spark.createDataFrame(texts, "node long, line string")
    score = linedup._score(df, 0.8)(spark.createDataFrame([(0, 1), (3, 4), (3, 5), (4, 2)], "lead long, node long"))
    got = {(r["lead"], r["node"]): r for r in score.collect()}
    s = {n: line_sets(x) for n, x in texts}
    for (a, b), r in got.items():
        assert r["sim"] == len(s[a] & s[b]) / len(s[a] | s[b]) and r["linked"] == (r["sim"] >= 0.8) and r["whole"] == len(s[a])
        assert (len(r["less"]), len(r["more"])) == ((len(s[a] - s[b]), len(s[b] - s[a])) if a == 3 else (0, 0))
        assert r["size"] == 8 * len(s[a] ^ s[b])
    assert len(got) == 4


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_leads_of_stars(spark, monkeypatch, rows):
    """Each key of two nodes or more has one lead, whether the larger keys are sent to all or joined by shuffle."""
    monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
    rng = random.Random(8)
    held = {(k, rng.randrange(60)) for k in range(80) for _ in range(rng.choice([1, 2, 2, 3, 9]))}
    of = {}
    for k, n in held:
        of.setdefault(k, set()).add(n)
    crowd = Counter()
    for nodes in of.values():
        if len(nodes) > 1:
            crowd.update({n: len(nodes) for n in nodes})
    want = set()
    for nodes in of.values():
        lead = min(nodes, key=lambda n: (-crowd[n], n))
        want |= {(lead, n) for n in nodes if n != lead}
    df = spark.createDataFrame(sorted(held), "key long, node long").repartition(3)
    assert sorted((r["lead"], r["node"]) for r in graph.stars(df, Scratch(spark)).collect()) == sorted(want)


def test_lines_joined_by_shuffle_alone(spark, monkeypatch):
    """Nothing is sent to every executor: what holds beyond BROADCAST_ROWS."""
    monkeypatch.setattr(linedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    rng = random.Random(12)
    pool = [prose(rng, 12).replace("\n", " ") for _ in range(15)] + ["ab" * 200, "ab" * 300, "short"]
    pool += [p[:40] + "#" + p[41:] for p in pool[:12]] + [p + "!" for p in pool[:12]]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(25)] + [(98, None), (99, "")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").repartition(3)
    want = cleaned(docs)
    rows = linedup.clean(df).collect()
    assert len(rows) == len(docs) + 3 and all(r["text"] == want[r["doc_id"]] for r in rows)
