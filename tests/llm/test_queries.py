"""The queries against their SQL on the small tables, and the others against brute force or held-out labels."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.queries import QUERIES, oracles
from tests.oracle import agree

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
ORACLES = oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    agree(QUERIES[name], ORACLES[name], spark, SF)


def pandas(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").toPandas()


def test_op8_certified_cutoffs_against_sql(spark):
    """On sf0.1 every language certifies cutoffs and rejects by them, as the SQL does."""
    sf = "/root/testdata/sf0.1"
    agree(QUERIES["op8_quality_rules"], ORACLES["op8_quality_rules"], spark, sf)
    got = QUERIES["op8_quality_rules"](spark, sf).toPandas().merge(pandas(spark, sf, "documents")[["doc_id", "lang"]], on="doc_id")
    assert (got[~got.base_failed & ~got.kept].groupby("lang").size() > 0).sum() == got.lang.nunique()


def test_op1_held_out_accuracy(spark):
    got = QUERIES["op1_langid_ftrl"](spark, LARGER).toPandas().merge(pandas(spark, LARGER, "documents"), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_op5_held_out_accuracy(spark):
    got = QUERIES["op5_quality_knn"](spark, LARGER).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    held = got[got.held_out].merge(pandas(spark, LARGER, "labels"), on="doc_id")
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9


def filled(sizes: dict, weights) -> dict:
    """Targets by pouring until nothing overflows."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: budget * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
            open_.discard(s)
    return out


def test_op2_targets_and_taken(spark):
    docs = pandas(spark, LARGER, "documents")
    got = QUERIES["op2_entropy_mix"](spark, LARGER).toPandas().merge(docs[["doc_id", "text", "source"]], on="doc_id")
    assert len(got) == len(docs)
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for n, t in zip(got["size"], got.text))
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    sizes = got.groupby("source")["size"].sum().to_dict()
    want = filled(sizes, (5, 2, 1))
    for s, x in got.groupby("source"):
        assert (x.source_size == sizes[s]).all() and x.target.iloc[0] == pytest.approx(want[s])
        assert abs(x.taken.sum() - want[s]) <= 0.01 * want[s]
        free = x[(x.rate < 2) & (x["size"] > 0)]
        if len(free) > 3:  # an exponential tilt: the log of the rate is proportional to the size
            slope = np.log(free.rate) / free["size"]
            assert slope.std() < 1e-6 * max(1.0, abs(slope.mean()) * 1e6) and np.allclose(slope, slope.mean(), rtol=1e-5, atol=1e-9)
    again = QUERIES["op2_entropy_mix"](spark, LARGER).toPandas()
    assert got[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def words(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("sf", [LARGER, "/root/testdata/sf0.1"])
def test_op6_recall_against_brute_force(spark, sf):
    docs, bench = pandas(spark, sf, "documents"), pandas(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_latent_decontamination"](spark, sf).toPandas().itertuples()}
    items = {r.item_id: words(r.text) for r in bench.itertuples()}
    index = defaultdict(set)
    for k, w in items.items():
        for p in zip(w, w[1:], w[2:]):
            index[p].add(k)
    truth = set()
    for r in docs.itertuples():
        w, at = words(r.text), defaultdict(list)
        for i, p in enumerate(zip(w, w[1:], w[2:])):
            for k in index.get(p, ()):
                at[k].append(i)
        for k, places in at.items():
            n = len(items[k])
            if any(sum(q <= z < q + n for z in places) > 0.2 * n and common(items[k], w[max(0, q - n) : q + 2 * n]) >= 0.7 * n for q in places[:1] + places[len(places) // 2 :][:1]):
                truth.add((r.doc_id, k))
    assert truth and len(got & truth) >= 0.9 * len(truth) and got <= truth | {x for x in got if x in truth} and len(got - truth) <= 0.05 * len(got)


def test_op3_planted_conversation(spark):
    r = QUERIES["op3_chat_trees"](spark, SF).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_native_queries_run_no_python(spark):
    for name in ("op3_chat_trees", "op8_quality_rules", "op10_licence_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_license_triggers_cover_every_sentence():
    from graphloom.llm import licenses

    assert all(re.search(licenses.TRIGGER, s) for s in licenses.SENTENCES)
    assert all(1 <= i <= len(licenses.SENTENCES) for _, seq in licenses.RULES for i in seq)


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "source_mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = p.STAGES[0][1](spark, docs, SF)
    assert first.columns == list(p.COLUMNS) and first.count() >= 0.95 * docs.filter("text <> ''").count()
    out = p.run(spark, SF)
    assert out.columns == [*p.COLUMNS, "copy"]
    rows = out.toPandas()
    assert rows.groupby("doc_id").size().max() <= 2 and 0 < rows.doc_id.nunique() <= docs.count()
    leaked = QUERIES["op6_latent_decontamination"](spark, SF).select("doc_id").distinct().toPandas().doc_id
    assert not set(rows.doc_id) & set(leaked)
    again = p.run(spark, SF).toPandas()
    order = ["doc_id", "copy"]
    assert rows.sort_values(order).values.tolist() == again.sort_values(order).values.tolist()
    comp = QUERIES["op7_prefix_tree_join"](spark, SF).filter("doc_id <> component_id and n_shingles > 0").toPandas().doc_id
    assert not set(rows.doc_id) & set(comp)
