"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import re
import types

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, features, langid, licenses, mixing, quality_knn, quality_rules, setjoin, substrings, urls
from graphloom.llm.wordarrays import Words, rolled_min, same_bytes
from graphloom.plans.scratch import Scratch

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, label int, n_words long, copies long"
EN, DE = "the cat and the dog sat on the mat with that other thing", "der hund und die katze sind nicht auf dem tisch mit ihr"


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, texts and sources, empty and white texts, repeated rows, a long text, and columns that operators use themselves."""
    rows = [(1, EN, "en", "a"), (1, EN, "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, " \n\t ", "de", "b"), (5, DE, "de", None), (6, LONG, "en", "a"), (None, EN, None, "c"), (7, "12 34 !!", "en", "c"), (8, EN.upper(), "en", "a"), (9, DE, "de", "é"), (10, "one two", "en", "b"), (11, "One two", "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, 0.5, "k", 1, 2, 3) for r in rows], SCHEMA).persist()


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


def test_langid(spark, docs):
    got = rows_of(langid.identify(docs, langid.train(docs)), "doc_id", "lang_pred", "score")
    assert len(got) == docs.count()
    und = {r[0] for r in got if r[1] == "und"}
    assert und == {2, 3, 4, 7} and all(0 <= r[2] <= 1 for r in got)
    assert {r[1] for r in got if r[0] in (5, 9)} == {"de"}
    none = langid.train(docs.limit(0))
    assert {r[1] for r in rows_of(langid.identify(docs, none), "doc_id", "lang_pred")} == {"und"}
    assert langid.identify(docs.limit(0), none).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (9, 0, 0), (6, None, 0), (77, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_knn.train(docs, labels)
    got = rows_of(quality_knn.classify(docs, model), "doc_id", "score", "predicted")
    assert len(got) == docs.count() and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got)
    assert all(s == pytest.approx(model.prior) for i, s, _ in got if i in (2, 3))
    empty = quality_knn.train(docs, labels.limit(0))
    assert len(quality_knn.classify(docs, empty).collect()) == docs.count()
    assert quality_knn.classify(docs.limit(0), model).count() == 0


def test_samples_stay_bounded_and_learn(spark):
    """Null ids, one id for all, and one text for most rows: the sample keeps its bound and both languages are learnt."""
    schema = "doc_id long, text string, lang string"
    sizes = lambda rows: dict(rows.groupBy("lang").count().collect())
    for ids in (None, 7):
        rows = [(ids, f"{EN} number {i}", "en") for i in range(300)] + [(ids, f"{DE} nummer {i}", "de") for i in range(300)] + [(ids, EN, "en")] * 2000
        df = spark.createDataFrame(rows, schema)
        draw = F.xxhash64("text")
        few = features.smallest(df, "lang", draw, {"en": 301, "de": 300}, 40)
        assert sizes(few) == {"en": 40, "de": 40} and few.distinct().count() == 80
        model = langid.train(df, per_lang=40)
        assert [model.predict(t)[0] for t in (EN, DE)] == ["en", "de"]
    marks = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (None, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(7, f"{EN} {i}") for i in range(200)] + [(8, DE)] * 50, "doc_id long, text string")
    model = quality_knn.train(docs, marks, per_label=30)
    assert len(model.vectors) == 31 and model.labels.sum() == 30


def test_ftrl_against_a_dense_version():
    """The sparse learner gives the weights of a plain one over dense vectors, coordinate by coordinate."""
    rng = np.random.default_rng(4)
    dim, classes = 30, 3
    rows = [(np.sort(rng.choice(dim, 6, replace=False)), rng.random(6), int(rng.integers(0, classes))) for _ in range(120)]
    l1 = 0.4
    model = langid.Ftrl(classes, dim, l1=l1)
    z, n = np.zeros((classes, dim + 1)), np.zeros((classes, dim + 1))
    for at, x, y in rows:
        model.learn(at, x, y)
        dense = np.zeros(dim + 1)
        dense[at], dense[dim] = x, 1.0
        w = np.zeros_like(z)
        for c in range(classes):
            for k in range(dim + 1):
                if abs(z[c, k]) > l1:
                    w[c, k] = -(z[c, k] - np.sign(z[c, k]) * l1) / ((langid.BETA + np.sqrt(n[c, k])) / langid.ALPHA + langid.L2)
        p = np.exp(w @ dense)
        p /= p.sum()
        for c in range(classes):
            g = (p[c] - (c == y)) * dense
            z[c] += g - (np.sqrt(n[c] + g * g) - np.sqrt(n[c])) / langid.ALPHA * w[c]
            n[c] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and (model.weights() == 0).any()


def test_votes_against_all_pairs(spark):
    """Scores are those of a plain loop over all labelled vectors, ties with the K-th included."""
    rng = np.random.default_rng(5)
    say = lambda good: " ".join(rng.choice(["fine", "clear", "prose", "text", "words"] if good else ["spam", "click", "buy", "now", "words"], 8))
    rows = [(i, say(i % 2)) for i in range(160)] + [(1000 + i, rows_text) for i, rows_text in enumerate([say(1)] * 5 + ["", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality_knn.train(df, marks)
    got = {r[0]: r[1] for r in quality_knn.classify(df, model).select("doc_id", "score").collect()}
    for i, t in rows:
        (v,) = model.embed([t or ""])
        cos = [round(float(np.float32(sum(a * b for a, b in zip(v.tolist(), x.tolist())))), 6) for x in model.vectors]
        least = sorted(cos, reverse=True)[min(quality_knn.K, len(cos)) - 1]
        near = [(max(c, 0) ** quality_knn.POWER, y) for c, y in zip(cos, model.labels) if c >= least - 2e-6]
        total = sum(w for w, _ in near)
        want = (sum(w * y for w, y in near) + model.prior) / (total + 1) if total else model.prior
        assert got[i] == pytest.approx(want, abs=0.05)
    assert len({got[1000 + i] for i in range(5)}) == 1


def test_mixing(spark, docs):
    got = mixing.mix(docs, Scratch(spark), keep=("text", "label")).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all() and (got.copies[got["size"] == 0] == 1).all()
    assert got[got.doc_id == 2]["size"].iloc[0] == 0
    assert mixing.mix(docs.limit(0), Scratch(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, "", "t")], "doc_id long, text string, source string")
    assert rows_of(mixing.mix(blank, Scratch(spark)), "doc_id", "taken", "target") == [(1, 0, 0.0), (2, 0, 0.0)]


def test_mixing_hot_cell(spark):
    """A third of all rows are copies of one text of one source: the copies differ by one at most and meet the target."""
    rows = [(i, "a b c" if i % 3 == 0 else "x " * (i % 40 + 1), "hot" if i % 3 == 0 else f"s{i % 4}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark)).toPandas()
    hot = got[got["size"] == 3]
    assert hot[hot.doc_id % 3 == 0].copies.max() - hot[hot.doc_id % 3 == 0].copies.min() <= 1
    by = got.assign(source=[rows[i][2] for i in got.doc_id]).groupby("source").agg(t=("target", "first"), n=("taken", "sum"))
    assert (abs(by.t - by.n) <= 0.01 * by.t).all()


def test_chat(spark):
    schema = "tree long, node long, parent long, role string, text string, score double, key string, leaf long, dist long"
    rows = [
        (1, 1, None, "user", "hi", None), (1, 2, 1, "assistant", "a", 0.1), (1, 3, 1, "assistant", "b <|turn|> <\\|end|>", 0.9), (1, 4, 3, "user", None, None),
        (2, 1, 99, "sys\ntem\\", "dangling parent", None), (3, 1, 2, "user", "circle", None), (3, 2, 1, "user", "circle", None),
        (None, 1, None, None, "no tree", None), (1, 2, 1, "assistant", "a", 0.1), (4, None, None, "user", "no node", None),
    ]
    nodes = spark.createDataFrame([(*r, "k", 1, 1) for r in rows], schema)
    got = {(r["tree"], r["rank"]): r for r in chat.format_trees(nodes, Scratch(spark), top=2).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1)}
    assert [tuple(t) for t in got[1, 1]["turns"]] == [("user", "hi"), ("assistant", "b <|turn|> <\\|end|>"), ("user", "")]
    assert [tuple(t) for t in got[1, 2]["turns"]] == [("user", "hi"), ("assistant", "a")]
    under = {k: [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss"]] for k, r in got.items()}
    assert under == {(1, 1): ["b <\\|turn|> <\\\\|end|>"], (1, 2): ["a"], (2, 1): [], (None, 1): []}
    assert [tuple(t) for t in got[2, 1]["turns"]] == [("sys\ntem\\", "dangling parent")]
    assert chat.format_trees(nodes.limit(0), Scratch(spark)).count() == 0


def test_chat_deep_tree_with_many_leaves(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i)) for i in range(100)] + [(1, 1000 + i, 99, "assistant", f"leaf{i}") for i in range(50)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string").withColumn("score", F.col("node").cast("double"))
    got = chat.format_trees(nodes, Scratch(spark), top=3).withColumn("turns", chat.parse(F.col("formatted"))).orderBy("rank").collect()
    assert [r["leaf"] for r in got] == [1049, 1048, 1047]
    assert [t["text"] for t in got[0]["turns"]] == [*map(str, range(100)), "leaf49"]


@pytest.mark.parametrize("top", [1, 3])
def test_chat_ranks_against_brute_force(spark, top):
    rng = np.random.default_rng(top)
    rows = [(int(t), n, None if n == 0 else int(rng.integers(max(0, n - 6), n)), "user" if n % 2 else "assistant", f"{t}.{n}", None if rng.random() < 0.2 else float(rng.integers(0, 8))) for t in range(12) for n in range(1 + 9 * (t % 5))]
    scratch = Scratch(spark)
    got = {(r["tree"], r["rank"]): (r["leaf"], r["score"], [x["text"] for x in r["turns"]]) for r in chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), scratch, top).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    want = {}
    for t in range(12):
        up = {n: (p, s) for tree, n, p, _, _, s in rows if tree == t}
        found = []
        for leaf in set(up) - {p for p, _ in up.values()}:
            way, at = [], leaf
            while at is not None:
                way.append(at)
                at = up[at][0]
            known = [up[n][1] for n in way if up[n][1] is not None]
            found.append((sum(known) / len(known) if known else None, leaf, [f"{t}.{n}" for n in reversed(way)]))
        found.sort(key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))
        want.update({(t, k + 1): (leaf, score, way) for k, (score, leaf, way) in enumerate(found[:top])})
    assert got == want


control = st.text(st.sampled_from("<[\\|/sINST]>turnend \nbé\U0001f600"), max_size=30)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.tuples(control, control), min_size=1, max_size=4), min_size=5, max_size=20))
def test_chat_round_trip(spark, conversations):
    df = spark.createDataFrame([(i, [{"role": r, "text": t} for r, t in c]) for i, c in enumerate(conversations)], "id int, turns array<struct<role: string, text: string>>")
    for r in df.withColumn("f", chat.render(F.col("turns"))).withColumn("back", chat.parse(F.col("f"))).collect():
        assert r["back"] == r["turns"]
        for piece in re.split(r"<\|turn\|>|<\|end\|>", r["f"]):
            assert not re.search(r"<\||</s>|<s>|\[/?INST\]", piece)


def test_substrings(spark, docs):
    got = rows_of(substrings.remove_repeats(docs, keep=("label", "source")), "doc_id", "n_words", "n_removed", "kept_text")
    assert len(got) == docs.count()
    by = {r[0]: r for r in got}
    assert by[2][1:] == (0, 0, "") and by[4][1:] == (0, 0, "") and by[6][1] == 60_000 and by[6][2] == 0
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def brute_windows(rows, k=13):
    least = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - k + 1):
            least.setdefault(tuple(w[j : j + k]), []).append(i)
    out = {}
    for i, t in rows:
        w = t.split()
        gone = {p for j in range(len(w) - k + 1) if min(least[tuple(w[j : j + k])]) < i for p in range(j, j + k)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


@pytest.mark.parametrize("buckets,settle", [(1, 1000), (7, 12 << 20)])
def test_substrings_brute_force(spark, monkeypatch, buckets, settle):
    rng = np.random.default_rng(1)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(300):
        w = [f"v{x}" for x in rng.integers(0, 60, rng.integers(0, 60))]
        if i % 3 == 0:
            at = rng.integers(0, len(w) + 1)
            w[at:at] = common[: rng.integers(10, 40)]
        if i % 7 == 0:
            w = w + ["same"] * 30
        rows.append((int(1000 - i), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substrings, "SETTLE", settle)
    got = dict(rows_of(substrings.remove_repeats(df, buckets=buckets), "doc_id", "kept_text"))
    assert got == brute_windows(rows)


def test_substrings_of_a_word_in_half_of_all_windows(spark):
    """Its windows are dealt by their own hashes: no bucket is more than twice the median, and the result stays exact."""
    rng = np.random.default_rng(3)
    words = np.array([f"long{i}" for i in range(3000)])
    rank = Words.of(*substrings.text_buffer(pa.array([" ".join(words)]))).hashes()
    hot = str(words[rank.argmin()])  # the minimiser of every window that has it
    rows = []
    for i in range(600):
        w = rng.choice(words, 120).tolist()
        w[:60] = [x if k % 9 else hot for k, x in enumerate(w[:60])]
        if i % 6 == 0:
            w[10:40] = rows[0][1].split()[10:40] if rows else w[10:40]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent = substrings.super_kmers(df.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text")), 16)
    size = sorted(r[1] for r in sent.filter("kind = 0").groupBy("bucket").agg(F.sum(F.length("part"))).collect())
    assert len(size) == 16 and size[-1] <= 2 * size[8]
    got = dict(rows_of(substrings.remove_repeats(df, buckets=16), "doc_id", "kept_text"))
    assert got == brute_windows(rows)


def test_settle_tells_colliding_hashes_apart(monkeypatch):
    texts = [" ".join(f"{p}{i}" for i in range(14)) for p in "abab"]
    words = Words.of(*substrings.text_buffer(pa.array(texts)))
    honest = substrings.settle(words, np.array([4, 3, 2, 1]))
    monkeypatch.setattr(substrings, "rolled", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    forced = substrings.settle(words, np.array([4, 3, 2, 1]))
    # zero hashes lump everything, so only the bytes can have told windows apart
    assert honest[1].tolist() == forced[1].tolist() == [True, True, True, True, False, False, False, False]


def test_word_arrays(monkeypatch):
    col = pa.array(["a  bé\x0bc", None, "", "  ", "X", "y" * 600_000 + " z"])
    w = Words.of(*substrings.text_buffer(col), lower=True)
    assert w.buf.tobytes().decode().split() == ["a", "bé", "c", "x", "y" * 600_000, "z"]
    assert w.first.tolist() == [0, 3, 3, 3, 3, 4, 6] and len(set(w.hashes().tolist())) == 6
    h = np.random.default_rng(0).integers(0, 99, 50)
    assert rolled_min(h, 13).tolist() == [min(h[i : i + 13]) for i in range(38)]
    b = np.frombuffer(b"abcabdab", np.uint8)
    assert same_bytes(b, np.array([0, 0, 0]), np.array([3, 3, 6]), np.array([2, 3, 0])).tolist() == [True, False, True]


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n, seed=5):
    """Families of near copies with edits around the limit, exact copies, and a passage that many share."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    bases = [[f"b{k}w{x}" for x in rng.integers(0, 500, rng.integers(3, 80))] for k in range(12)]
    rows = []
    for i in range(n):
        w = list(bases[i % 12]) if i % 4 else [f"u{i}x{j}" for j in range(40)]
        for _ in range(int(rng.integers(0, 4))):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, 9)}"
        if i % 5 == 0:
            w = w + passage
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [5, 400])
def test_set_join_brute_force(spark, monkeypatch, block):
    """A small block bound sends everything through parts, families and shingle blocks."""
    rows = near_copies(260)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(setjoin.link_sets, "__defaults__", (block,))
    got = {r[0]: r[1:] for r in rows_of(setjoin.components(df, Scratch(spark)), "doc_id", "n_shingles", "component_id")}
    assert got == jaccard_components(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=9), min_size=2, max_size=14))
def test_trie_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = list(range(len(sets)))

    def find(x, r):
        while r[x] != x:
            x = r[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                root[max(find(a, root), find(b, root))] = min(find(a, root), find(b, root))
    mine = list(range(len(sets)))
    for a, b in setjoin.Trie(arrays).links(list(range(len(sets)))):
        assert 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])
        x, y = find(a, mine), find(b, mine)
        mine[max(x, y)] = min(x, y)
    assert [find(i, root) for i in range(len(sets))] == [find(i, mine) for i in range(len(sets))]


def test_set_join_edges(spark, docs):
    got = rows_of(setjoin.components(docs, Scratch(spark)), "doc_id", "n_shingles", "component_id")
    assert len(got) == docs.count()
    by = {r[0]: r[1:] for r in got}
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4) and by[8] == (by[1][0], 1) and by[9][1] == 5 and by[11] == (1, 10) and by[None][1] == 1
    assert setjoin.components(docs.limit(0), Scratch(spark)).count() == 0


def linked(sets):
    """Components of sets by brute force, as a set of frozensets of numbers."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = {}
    for i in range(len(sets)):
        out.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def chained_pairs(n, seed=3):
    """Pairs of sets of 8 shingles that link by 7, the least of each being one that the next pair has too.

    Both minimum hashes tell the sets of a pair apart, and their second and third shingles lie on both sides of 2^63.
    """
    from graphloom.llm.wordarrays import mixed

    rng, out = np.random.default_rng(seed), []
    chain = rng.integers(0, 1 << 60, 100 * n, dtype=np.uint64)
    chain = np.sort(chain[mixed(chain) < np.uint64(1 << 60)][: n + 1])
    assert len(chain) == n + 1
    while len(out) < 2 * n:
        own = chain[len(out) // 2 : len(out) // 2 + 2]
        common = np.append(rng.integers(1 << 61, 1 << 63, 1, dtype=np.uint64), rng.integers(1 << 63, (1 << 64) - 1, 6, dtype=np.uint64))
        if mixed(own).max() < mixed(common).min():
            out += [{*common.tolist(), int(x)} for x in own]
    return out


def test_digests_that_agree_in_part_link(spark, monkeypatch):
    """Sets whose digests agree in all but the last bits are still two, and link."""
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, text + " more or less")], "doc_id long, text string").repartition(3)

    def alike(sets):
        return np.array([(7, (7 << 32) | len(s)) for s in sets], np.uint64).reshape(-1, 2)

    monkeypatch.setattr(setjoin, "digests", alike)
    # a function of another name goes to the workers by value, with the digests above
    whole = types.FunctionType(setjoin._whole.__code__, vars(setjoin) | {"digests": alike})
    whole.__qualname__ = "whole"
    monkeypatch.setattr(setjoin, "_whole", whole)
    assert rows_of(setjoin.components(df.coalesce(1), Scratch(spark)), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("block", [3, 1 << 21])
def test_asked_shingles_settle_block_by_block(monkeypatch, block):
    """Counts agree with a plain count whatever the block; what is shared is kept once."""
    monkeypatch.setattr(setjoin, "SETTLE", block)
    rng = np.random.default_rng(6)
    for labels in (False, True):
        asked, got, truth, of = setjoin.Asked(), {}, {}, {}
        for chunk in range(30):
            key = np.unique(rng.integers(0, 40, 8)).astype(np.uint64)
            local = rng.integers(0, 3, len(key)).astype(np.uint32)
            own = rng.integers(0, 2, (3, 2)).astype(np.uint64)
            for k, i in zip(key.tolist(), local.tolist()):
                of.setdefault(k, []).append((chunk, i, tuple(own[i].tolist()) if labels else (chunk, i)))
            if asked.add(key, chunk, local, own[local] if labels else None):
                for c, _, part in asked.settle(labels):
                    for i, n in zip(*setjoin._unpack(part, (np.uint32, np.uint32))):
                        got[c, int(i)] = got.get((c, int(i)), 0) + int(n)
        for c, _, part in asked.settle(labels):
            for i, n in zip(*setjoin._unpack(part, (np.uint32, np.uint32))):
                got[c, int(i)] = got.get((c, int(i)), 0) + int(n)
        for askers in of.values():
            if len({a[2] for a in askers}) > 1:
                for c, i, _ in askers:
                    truth[c, i] = truth.get((c, i), 0) + 1
        assert got == truth and asked.size <= sum(len(a) for a in of.values())


@pytest.mark.parametrize("block", [3, 1 << 21])
def test_counted_shingles_get_one_frequency(monkeypatch, block):
    """Every asker of a shingle that several labels hold gets the same capped count, whenever it is settled; others get none."""
    monkeypatch.setattr(setjoin, "SETTLE", block)
    monkeypatch.setattr(setjoin, "FREQUENT", 5)
    rng = np.random.default_rng(9)
    counted, got, of = setjoin.Counted(), {}, {}

    def note(rows):
        for c, _, part in rows:
            for i, k, m in zip(*(x.tolist() for x in setjoin._unpack(part, (np.uint32, np.uint64, np.uint32)))):
                got.setdefault(k, []).append((c, i, m))

    for chunk in range(30):
        key = np.sort(rng.zipf(1.5, 12) % 30).astype(np.uint64)
        local = rng.integers(0, 3, len(key)).astype(np.uint32)
        own = rng.integers(0, 2, (3, 2)).astype(np.uint64)
        for k, i in zip(key.tolist(), local.tolist()):
            of.setdefault(k, []).append((chunk, i, tuple(own[i].tolist())))
        if counted.add(key, chunk, local, own[local]):
            note(counted.settle())
    note(counted.settle(last=True))
    several = {k: a for k, a in of.items() if len({x[2] for x in a}) > 1}
    assert set(got) == set(several)
    for k, a in several.items():
        assert sorted(got[k]) == sorted((c, i, min(5, len(a))) for c, i, _ in a)


@pytest.mark.parametrize("copies", [1, 2])
@pytest.mark.parametrize("kind", ["chained", "random"])
def test_set_join_shingle_blocks_brute_force(spark, kind, copies):
    """Few sets a block send open families to shingle blocks; shingles fill all 64 bits and sets may come twice."""
    from graphloom.llm.wordarrays import mixed

    if kind == "chained":
        sets = chained_pairs(30)
    else:
        rng = np.random.default_rng(8)
        pool = rng.integers(0, (1 << 64) - 1, 400, dtype=np.uint64).tolist()
        sets = []
        for _ in range(60):
            at = int(rng.integers(0, 380))
            base = set(rng.choice(pool[at : at + 20], int(rng.integers(4, 17)), replace=False).tolist())
            sets += [base, *({*rng.permutation(sorted(base))[: len(base) - 1].tolist(), int(rng.choice(pool))} for _ in range(3))]
        sets = [set(s) for s in {frozenset(s) for s in sets}]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    rows = [(i, len(a), a.tobytes(), int(a[0] >> np.uint64(1)), int(mixed(a).min() >> np.uint64(1))) for i, a in enumerate(arrays)]
    df = spark.createDataFrame([(bytearray(r[0].to_bytes(16, "big")), r[1], bytearray(r[2]), r[3], r[4]) for r in rows] * copies, "sid binary, n long, tokens binary, k0 long, k1 long")
    links = setjoin.link_sets(Scratch(spark).save(df), Scratch(spark), 5).collect()
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        x, y = (find(int.from_bytes(e, "big")) for e in (u, v))
        root[max(x, y)] = min(x, y)
    got = {}
    for i in range(len(sets)):
        got.setdefault(find(i), set()).add(i)
    assert {frozenset(g) for g in got.values() if len(g) > 1} == linked(sets)


def test_set_join_keeps_every_repeated_row(spark):
    """Chunks that hold the same rows: halves batched alike, a repeated text that fills a chunk, null ids batch after batch."""
    schema = "doc_id long, text string"
    half = spark.createDataFrame(near_copies(40), schema).coalesce(1)
    long = spark.createDataFrame([(500, "long " * 150_000 + "end")] * 3, schema).repartition(1)
    nulls = spark.range(0, 3500, 1, 1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(EN).alias("text"))
    once = jaccard_components(near_copies(40))
    got = rows_of(setjoin.components(half.union(half).union(long).union(nulls), Scratch(spark)), "doc_id", "n_shingles", "component_id")
    assert len(got) == 80 + 3 + 3500
    assert sorted(r for r in got if r[0] not in (500, None)) == sorted([(i, *x) for i, x in once.items()] * 2)
    assert [r[0] for r in got].count(500) == 3 and {r[1] for r in got if r[0] is None} == {len(EN.split()) - 4}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, EN), (2, None), (3, ""), (4, "one two"), (5, "never found anywhere in these few texts at all")], "item_id long, text string")
    got = rows_of(decontaminate.leaks(docs, bench, Scratch(spark)), "doc_id", "item_id")
    assert {g for g in got if g[1] == 1} == {(1, 1), (8, 1), (None, 1)} and {g for g in got if g[1] == 4} == {(10, 4), (11, 4)} and not any(g[1] == 5 for g in got)
    assert decontaminate.leaks(docs, bench.limit(0), Scratch(spark)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench, Scratch(spark)).count() == 0


def test_decontamination_item_ids(spark):
    """Null, repeated and string item ids; several blocks in one pass and in passes of their own."""
    docs = spark.createDataFrame([(1, EN + " and more"), (2, DE), (None, EN)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, EN), (5, DE), (5, DE), (5, "no such words"), (6, EN)], "item_id long, text string")
    want = [(1, 6), (1, None), (2, 5), (None, 6), (None, None)]
    found = lambda b: rows_of(decontaminate.leaks(docs, b, Scratch(spark)), "doc_id", "item_id")
    assert found(bench) == sorted(want, key=repr)
    text = bench.withColumn("item_id", F.concat(F.lit("item"), F.col("item_id").cast("string")))
    assert found(text) == sorted([(d, i and f"item{i}") for d, i in want], key=repr)


@pytest.mark.parametrize("bytes", [1, 64 << 20])
def test_decontamination_blocks(spark, monkeypatch, bytes):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", bytes)
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice([f"term{i}" for i in range(900)], n))
    items = [say(30) for _ in range(10)]
    docs = spark.createDataFrame([(i, say(50) + " " + x + " " + say(50)) for i, x in enumerate(items)] + [(100 + i, say(120)) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert rows_of(decontaminate.leaks(docs, bench, Scratch(spark)), "doc_id", "item_id") == sorted([(i, i) for i in range(10)], key=repr)


def test_latent_space_acts(spark):
    """Far fewer directions than words, other shares than plain TF-IDF, and other candidates without the space."""
    path = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, scratch = docs.select("text"), Scratch(spark)
    df, n = decontaminate.passage_frequency(texts)
    idf = (1 + np.log((1 + n) / (1 + df))).astype(np.float32)
    latent = decontaminate.block_index(bench.select("item_id", "text"), decontaminate.sample_of(texts, n, scratch), idf, scratch)
    words = np.unique(decontaminate.numbers(np.array([w for x in latent.items for w in x.words], np.uint64)))
    plain = decontaminate.Index(latent.items, idf, words, np.eye(len(words), 1, dtype=np.float32), latent=False)
    assert latent.rank < 0.2 * len(words) and latent.latent.mean() > 0.9
    assert np.abs(latent.share - plain.share).max() > 0.1 * np.abs(plain.share).max()
    cut, h = decontaminate.cut(pa.array([r[0] for r in texts.collect()]))
    near = [set(zip(*(x.tolist() for x in decontaminate.near_windows(cut, h, ix, decontaminate.COSINE)[1:]))) for ix in (latent, plain)]
    assert near[0] - near[1] and near[1] - near[0], (len(near[0]), len(near[1]))


def test_decontamination_finds_paraphrases_by_the_answer(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"term{i}" for i in range(4000)]
    say = lambda n: list(rng.choice(vocabulary, n))
    item = say(40)
    changed = [w if i % 5 not in (1, 3) or i > 33 else "changed" for i, w in enumerate(item)]  # 60 % of the words, the answer kept
    rows = [(i, " ".join(say(300))) for i in range(200)] + [(900, " ".join(say(100) + item + say(100))), (901, " ".join(say(90) + changed + say(110)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert rows_of(decontaminate.leaks(df, bench, Scratch(spark)), "doc_id", "item_id") == [(900, 7), (901, 7)]


def test_decontamination_finds_items_of_frequent_words(spark):
    """One document that is the item; a third of all rows holding it; an item made of words that every text has."""
    rng = np.random.default_rng(4)
    say = lambda k, n: " ".join(rng.choice([f"term{i}" for i in range(k)], n))
    item, plain = say(4000, 40), say(12, 30)
    schema = "doc_id long, text string"
    bench = spark.createDataFrame([(7, item), (8, plain)], "item_id long, text string")
    found = lambda rows: rows_of(decontaminate.leaks(spark.createDataFrame(rows, schema), bench, Scratch(spark)), "doc_id", "item_id")
    assert found([(1, item)]) == [(1, 7)]
    rows = [(i, item if i % 3 == 0 else say(4000, 60) + " " + say(12, 8)) for i in range(150)]
    held = [(900, f"{say(4000, 70)} {item} {say(4000, 70)}"), (901, f"{say(4000, 70)} {plain} {say(4000, 70)}")]
    assert set(found(rows + held)) == {(i, 7) for i in range(0, 150, 3)} | {(900, 7), (901, 8)}
    common = [(i, say(12, 8) + " " + say(4000, 20)) for i in range(100)]
    assert found([*common, held[1]]) == [(901, 8)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=14))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    item = decontaminate.Item(1, a)
    assert decontaminate.lcs(item.places, item.n, b) == row[-1]


def test_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_rules.judge(docs, labels, Scratch(spark)), "doc_id", "n_words", "n_repeat_words", "base_failed", "kept")
    assert len(got) == docs.count()
    by = {r[0]: r for r in got}
    assert by[2][1:] == (0, 0, True, False) and by[6][1:4] == (60_000, 60_000, True) and by[1][3:] == (False, True)
    assert quality_rules.judge(docs.limit(0), labels, Scratch(spark)).count() == 0
    assert quality_rules.judge(docs, labels.limit(0), Scratch(spark)).count() == docs.count()


def test_binomial_bound_is_exact(spark):
    from math import comb, log

    df = spark.createDataFrame([(k, n) for n in (1, 40, 300) for k in (0, 1, 7, 30) if k <= n], "k long, n long")
    for k, n, got in df.select("k", "n", quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), 0.05)).collect():
        want = log(sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)))
        assert got == pytest.approx(want, abs=1e-9)


def test_certified_cutoffs_keep_their_promise(spark):
    """On labelled good documents a certified rule rejects at most ALPHA, whatever the stratum."""
    rows = [("a", 100, 5 if i % 500 == 0 else 0, 0, 0, 500) for i in range(20000)] + [("b", 100, 0, 0, 0, 500) for i in range(5)]
    good = spark.createDataFrame(rows, "stratum string, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, word_chars long")
    got = {r["stratum"]: r for r in quality_rules.certified(good).collect()}
    assert got["a"]["cut_symbols"] == 0.05 and got["b"]["cut_symbols"] is None


def test_rules_of_strata_on_both_sides_of_the_least_label_count(spark, tmp_path):
    """With the least count a stratum certifies cutoffs and rejects by them, with one document less it rejects nothing; the SQL agrees."""
    from math import ceil, log

    from tests.oracle import agree

    least = ceil(log(quality_rules.DELTA / (2 * len(quality_rules.RULES))) / log(1 - quality_rules.ALPHA))
    rows, labels = [], []
    for lang, n in (("aa", least), ("bb", least - 1)):
        for i in range(n):
            rows.append((len(rows), " ".join(f"w{i}x{j}" for j in range(12)), lang))
            labels.append((rows[-1][0], 1, 0))
        rows += [(len(rows) + i, " ".join(f"# $ w{i}x{j}" for j in range(12)), lang) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    marks.toPandas().to_parquet(tmp_path / "labels.parquet")
    agree(lambda s, _: quality_rules.judge(docs, marks, Scratch(s)), quality_rules.oracle(), spark, str(tmp_path))
    kept = dict(quality_rules.judge(docs, marks, Scratch(spark)).select("doc_id", "kept").collect())
    assert [sum(kept[r[0]] for r in rows if r[2] == lang) for lang in ("aa", "bb")] == [least, least - 1 + 20]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.Example.com/en/71?x", "k"), (2, "http://example.com/en/8", "k"), (3, None, "k"), (4, "no scheme", "k"), (5, "s://b.net/de/#f", "k"), (6, "s://x.example.net/de/80", "k"), (7, "s://org/es/", "k"), (8, "s://bad.test/1.html", "k"), (8, "s://bad.test/1.html", "k"), (None, "s://HÖST/p", "k")],
        "page_id long, url string, rule string",
    )
    outcomes = spark.createDataFrame([(8, 1.0)], "_page long, bad double")
    got = rows_of(urls.judge(pages, outcomes, Scratch(spark)), "page_id", "host", "path", "rule", "verdict")
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 10
    assert by[1] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and by[2] == ("example.com", "/en/8", "com/en/", "block")
    assert by[3][:3] == by[4][:3] == ("", "", None) and by[5][2:] == ("net/de/", "allow") and by[6][2:] == ("example.net/de/8", "block") and by[7][2:] == ("org/es/", "block")
    assert by[None][0] == "hÖst"
    assert urls.judge(pages.limit(0), outcomes, Scratch(spark)).count() == 0


def test_reputation_shrinks(spark):
    """A host with many bad pages is blocked, one with a single bad page among good siblings isn't."""
    rows = [(f"h{k}.fine.com", 1.0 if i % 20 == 0 else 0.0) for k in range(8) for i in range(40)] + [("spam.worse.com", 1.0)] * 60 + [("h0.fine.org", 0.0)] * 30 + [("once.fine.com", 1.0)] + [("new.fine.com", None)]
    got = dict(rows_of(urls.reputations(spark.createDataFrame(rows, "host string, bad double"), Scratch(spark)), "host", "lower"))
    assert got["spam.worse.com"] > urls.LIMIT > max(v for h, v in got.items() if h != "spam.worse.com") and "new.fine.com" in got


def test_suffixes_are_a_parameter(spark):
    df = spark.createDataFrame([("a.b.co.zz",)], "h string")
    assert tuple(df.select(urls.domain_of(F.col("h"), ("co.zz",)), urls.suffix_of(F.col("h"), ("co.zz",)), urls.domain_of(F.col("h"))).first()) == ("b.co.zz", "co.zz", "co.zz")


def test_domains(spark):
    df = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "x.example.com", "example.com", "com", "")], "h string")
    assert [tuple(r) for r in df.select(urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("com", "com"), ("", "")]


MIT = """MIT License

Copyright (c) 2020 Some One, Inc. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """BSD 2-Clause License

Copyright (c) 2015, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2.replace("2-Clause", "3-Clause") + """3. Neither the name of Some Company nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
APACHE = """/*
 * Copyright 2019 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS.
 */
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software:", "software;").replace("version 3", "version 2")


def notices():
    """(id, text, licences): whole files, single lines, sequences that a strange sentence breaks."""
    first, second = MIT.split("\n\n")[2:4]
    texts = [
        (MIT, "MIT"), (MIT.replace("\n", "\r\n"), "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (GPL3, "GPL-3.0"), (GPL2, "GPL-2.0"),
        (" Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS", "Apache-2.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Copyright", "GPL-2.0"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("SPDX-License-Identifier: ISC", "ISC"),
        ("Text.\nLicensed under CC BY-NC 4.0.\nmore", "CC-BY-NC-4.0"), ("the above copyright notice", ""), ("MIT License", ""), (LONG + "\nReleased under the MIT License.", "MIT"), (LONG + "\n" + MIT + LONG, "MIT"),
        (first + "\n\n" + second, "MIT"), (first + "\n\nDo not. At all.\n\n" + second, ""), (MIT + "\n\n" + GPL3, "GPL-3.0,MIT"), (None, ""), ("", ""), (MIT, "MIT"),
    ]
    return [(100 + i, *t) for i, t in enumerate(texts)]


def test_licences(spark, docs, tmp_path):
    from tests.oracle import agree

    rows = notices()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert dict(rows_of(licenses.recognise(df), "doc_id", "licences")) == {i: want for i, _, want in rows}
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    agree(lambda s, _: licenses.recognise(df), licenses.oracle(), spark, str(tmp_path))
    assert {r[1] for r in rows_of(licenses.recognise(docs), "doc_id", "licences")} == {""} and licenses.recognise(docs.limit(0)).count() == 0


def test_licence_rules_are_parameters_and_ordered(spark):
    """The longer rule takes its sentences; of two of one length the first does."""
    df = spark.createDataFrame([(1, "A permit. B permit. C permit. A permit. B permit."), (2, "A permit. Other. B permit.")], "doc_id long, text string")
    sentences = ("a permit", "b permit", "c permit")
    found = lambda *rules: dict(rows_of(licenses.recognise(df, sentences=sentences, rules=rules), "doc_id", "licences"))
    assert found(("ab", (1, 2)), ("abc", (1, 2, 3))) == {1: "ab,abc", 2: ""}
    assert found(("bc", (2, 3)), ("ab", (1, 2)), ("ca", (3, 1))) == {1: "ab,bc", 2: ""}
    assert found(("ca", (3, 1)), ("b", (2,))) == {1: "b,ca", 2: "b"}


def test_pipeline_stages_against_brute_force(spark):
    """One row a component, by (doc_id, hash of the text), with clashing and null ids; windows as by hand; leaks and copies as told."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    texts = [t for _, t in near_copies(90)]
    ids = [None if i % 11 == 0 else 5 if i % 7 == 0 else 100 + i for i in range(90)]
    rows = [(i, t, "en", f"s{k % 3}", len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    keys = dict(df.select("text", F.xxhash64("text")).distinct().collect())
    by = jaccard_components(list(enumerate(texts)))
    name = lambda k: (2**63 - 1 if ids[k] is None else ids[k], keys[texts[k]])
    groups = {}
    for k in range(90):
        groups.setdefault(by[k][1], []).append(k)
    want = [(ids[k], texts[k]) for k in (min(g, key=name) for g in groups.values())]
    near = p.near_duplicates(spark, df, sf)
    assert rows_of(near, "doc_id", "text") == sorted(want, key=repr)

    plain = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], df.schema)
    cut = {i: t for i, t in brute_windows(list(enumerate(texts))).items() if t}
    assert dict(rows_of(p.substring_dedup(spark, plain, sf), "doc_id", "text")) == cut

    items = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").limit(5).collect()]
    held = spark.createDataFrame([(i if i else None, f"{t} {items[i // 3] if i % 3 == 0 else ''}", "en", "s", 1) for i, t in enumerate(texts[:15])], df.schema)
    assert sorted((r[0] for r in p.decontamination(spark, held, sf).select("doc_id").collect()), key=repr) == [i for i in sorted(range(15), key=repr) if i % 3]

    mixed = rows_of(p.source_mix(spark, plain, sf), "doc_id", "copy")
    taken = sum(len(texts[i].split()) for i, _ in mixed)
    assert abs(taken - 1.5 * sum(len(t.split()) for t in texts)) < 60 and all(c <= 2 for _, c in mixed) and len(mixed) == len(set(mixed))


def test_stages(spark, docs):
    import corpus_pipeline as p

    for table in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert out.columns[:5] == list(p.COLUMNS), name
            n = out.count()
            assert n <= 2 * table.count(), name
