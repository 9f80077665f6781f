"""Operators 7, 9 and 10, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import labelled, pq, quality, queries, toxicity
from waymark.llm.scratch import save


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(pq, "CHUNK", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + rng.normal(size=24) * rng.choice([0.05, 0.1, 0.3])).tolist(), int(i % 3)) for i in range(500)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(90)] + [(2000 + i, (np.array(rows[9][1]) + rng.normal(size=24) * 0.02).tolist(), 0) for i in range(120)]
    odd = [(3000, None, 1), (3001, [0.0] * 24, 1), (3002, [float("nan")] * 24, 1), (3003, [None] + [1.0] * 23, 1), (3004, rows[0][1], None), (3005, [1.0, 2.0], 0), (3006, [], 0), (3007, [float("inf")] * 24, 2)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("found", F.lit("clash"))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    groups = brute.Groups()
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.join(rows[a][0], rows[b][0])
    want = {r[0]: (int(near[i].sum()) - 1, groups.root(r[0])) for i, r in enumerate(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(table).collect()}
    assert all(got[r[0]] == (0, r[0]) for r in odd)
    assert {k: got[k] for k in want} == want
    assert pq.near_duplicates(table.where("vec_id < 0")).count() == 0
    assert pq.near_duplicates(table.where("vec_id in (3000, 3006)")).count() == 2


def test_pairs_at_the_threshold_and_vectors_of_several_lengths(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(600):  # pairs at cosines from 0.980 to 0.984
        x, y = rng.normal(size=(2, 32))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        c = 0.98001 + 0.004 * i / 600
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    rows += [(5000, [1.0, 2.0]), (5001, [2.0, 4.0]), (5002, [1.0, -2.0]), (5003, [1.0, 2.0, 0.0]), (5004, [7.0])]
    rows += [(6000, [1e200, 2e200, 0.0]), (6001, [1e-200, 2e-200, 0.0]), (6002, [1e-310, 2e-310, 0.0])]  # their squares overflow or vanish
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == (1, i - i % 2) for i in range(1200))
    assert [got[5000 + i] for i in range(5)] == [(1, 5000), (1, 5000), (0, 5002), (3, 5003), (0, 5004)]
    assert [got[6000 + i] for i in range(3)] == [(3, 5003)] * 3


def test_lengths_that_few_vectors_have(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=(8, 9, 16)[i % 3]) + 2 * (i % 7)).tolist(), i % 2) for i in range(700)]
    rows += [(700 + i, rows[i][1], rows[i][2]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    alike = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(table).collect()}
    monkeypatch.setattr(pq, "RARE", 0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(table).collect()} == alike
    assert sum(n for n, _ in alike.values()) > 120


def test_a_repeated_id_gives_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 1)], "doc_id long, toxic int")
    assert [tuple(r) for r in labelled.sample(docs, labels, "toxic", F.lit(True)).collect()] == [(1, 1, "")]


def test_coding_error_bounds_the_distance():
    x = np.random.default_rng(1).normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = pq.Model(x, 300)
    cell = model.probes(x)[:, 0]
    assert model.probes(x).shape[1] == min(pq.PROBES, len(model.cells)) and len(cell) == 300
    residual = x - model.cells[0]
    codes, left = model.codes(residual)
    far = sum(t[:, c] for t, c in zip(model.tables(residual), codes.T, strict=True))
    true = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert (np.sqrt(far) <= true + left + 1e-9).all()


def labelled_docs(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for i in range(900):
        text, bad, toxic = prose(rng.randint(20, 120)), rng.random() < 0.15, rng.random() < 0.15
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "###" for w in text.split()), "Same " * 60, " | ".join(text.split())])
        if toxic:
            w = text.split()
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["zzloser", "zzmoron", "qqstem" + rng.choice(vocabulary)]))
            text = " ".join(w)
        rows.append((i, text))
        if i % 10:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "x" * 200_000)]
    labels += [(None, 1, 1), (5001, None, None), (3, None, 0), (3, 1, 1), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, operator, column):
    docs, labels = labelled_docs(spark)
    out = operator.classify(docs.withColumn("score", F.lit("clash")), labels)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 for r in got.values())
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None and r.doc_id != 3 and r[column] is not None}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 100 and sum(got[d].predicted == truth[d] for d in held) >= 0.95 * len(held)
    assert operator.classify(docs, labels.where("doc_id < 0")).where("score is null").count() == 0
    assert operator.classify(docs.where("doc_id < 0"), labels).count() == 0


def test_few_labels_still_make_a_classifier(spark):
    docs, labels = labelled_docs(spark)
    few = labels.where("doc_id < 120 and toxic is not null")
    got = {r.doc_id: r for r in toxicity.classify(docs, few).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id not in (None, 3) and r.toxic is not None}
    assert len({r.score for r in got.values()}) > 10
    assert sum(got[d].predicted == t for d, t in truth.items()) >= 0.9 * len(truth)


@pytest.mark.parametrize("name, column, cut", [("op9_toxicity", "toxic", 0.5), ("op10_quality", "quality", 0.3)])
def test_classifier_queries(spark, tmp_path, name, column, cut):
    docs, labels = labelled_docs(spark)
    docs = docs.union(docs.where("doc_id < 5"))
    docs.withColumn("predicted", F.lit("clash")).withColumn("held_out", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == 908 and all(r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id not in (None, 3) and r[column] is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled_docs(spark)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert first == {r.doc_id: r.score for r in quality.classify(docs, other).collect()}


def test_quality_learns_from_every_labelled_row(spark):
    """No bound on rows or pairs: what the fit is given, however much it is, is compared; the threshold is the quantile of all scores."""
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 40 != 0), "Good words of some length. " * int(rng.integers(2, 9)) if i % 40 else "### " * int(rng.integers(5, 50))) for i in range(labelled.SAMPLE + 2000)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k, _ in rows], "doc_id long, quality int")
    every = labelled.every(docs, labels, "quality", F.lit(True))
    assert every.count() == len(rows)
    features = quality._features(every)
    n = {k: sum(x[1] == k for x in rows) for k in (0, 1)}
    dealt = quality._dealt(features, n).select("part", F.size("bad").alias("bad"), F.size("good").alias("good")).collect()
    assert sum(r.good for r in dealt) == n[1] and sum(r.bad for r in dealt if r.part == 0) == n[0]
    assert min(r.bad for r in dealt) > 0 and max(r.good for r in dealt) < 2 * quality.WIDTH
    model, again = quality.fit(every), quality.fit(every.repartition(7))
    assert (model.weights == again.weights).all() and model.threshold == again.threshold and model.slope == again.slope


def test_a_step_of_the_fit_has_no_shuffle(spark):
    """One row for each task, whatever the number of shuffle partitions."""
    rows, jobs = spark.range(1000).repartition(7).selectExpr("cast(id as double) raw").localCheckpoint(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sums", "one step")
    try:
        made = quality._sums(rows, 3, lambda raw: quality._whole(np.array([len(raw), raw.to_numpy().sum(), 0.5])))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(made[:2]) == [1000, 499500]
    stages = [x for j in jobs.getJobIdsForGroup("sums") for x in jobs.getJobInfo(j).stageIds]
    assert len(stages) == 1 and jobs.getStageInfo(stages[0]).numTasks == 7


@pytest.mark.parametrize("below", [1, 7, 399, 400, 799])
def test_threshold_is_the_quantile_of_all_scores(spark, below):
    values = np.concatenate([np.random.default_rng(1).normal(size=600), np.full(150, 0.25), [1e9] * 50])
    raw = spark.createDataFrame([(float(x),) for x in values], "raw double")
    assert quality._quantile(raw, below, len(values)) == pytest.approx(np.quantile(values, below / len(values)), abs=1e-5)


def test_groups_of_a_rare_label_are_dealt_in_parts(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc"), (F.col("id") != 5).cast("int").alias("label"), F.lit(b"f").alias("f"))
    parts = quality._dealt(rows, {0: 1, 1: 8999}).select(F.size("bad").alias("bad"), F.size("good").alias("good")).collect()
    assert len(parts) == 5 and all(r.bad == 1 for r in parts) and sum(r.good for r in parts) == 8999


def test_correlated_voters_share_their_weight():
    rng = np.random.default_rng(0)
    toxic = rng.random(2000) < 0.2
    one = (rng.random(2000) < np.where(toxic, 0.6, 0.01)).astype(float)
    two = (rng.random(2000) < np.where(toxic, 0.6, 0.01)).astype(float)
    entries = np.stack([one, one, one, two], axis=1)
    v = np.concatenate([entries, (entries.sum(1, keepdims=True) == 0), np.zeros((2000, 3))], axis=1)
    post, rates, together = toxicity.label_model(v, 0.2, 4)
    assert together[0, 1] > 0.5 and (rates[1][:4] > rates[0][:4]).all()
    assert ((post > 0.5) == toxic).mean() > 0.9


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = labelled_docs(spark)
    item = " ".join(f"bench{i}" for i in range(20))
    more = [(6000, f"{item} and so on"), (6001, "Write to me at some.one@mail.example.org or +1 (988) 555-2485 please, thank you."), (6002, "Write to me at some.one@mail.example.org or +1 (988) 555-2485 please, thank you.")]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    full = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    full.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in pipeline.STAGES:
        before = now
        now = save(stage(spark, before, str(tmp_path)))
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
        if stage is not pipeline.STAGES[-1][1]:
            assert now.columns == pipeline.COLUMNS
        if stage is pipeline.dedup_stage:
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert kept[-1] == {d for d, (_, root) in brute.near_duplicates(rows).items() if d == root}
        if stage is pipeline.pii_stage:
            got = {r.doc_id: r for r in now.collect()}
            assert "[EMAIL]" in got[6001].text and "[PHONE]" in got[6001].text and got[6001].n_chars == len(got[6001].text)
    assert 6002 not in kept[1] and 6000 in kept[1] and 6000 not in kept[2] and kept[2] == kept[3] == kept[4]
    assert {r.doc_id: r.decoded for r in now.collect()} == {d: r.text or "" for d, r in got.items()}
    assert pipeline.run(spark, str(tmp_path)).count() == len(kept[-1])


def test_dedup_stage_drops_copies_at_80_per_cent(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for n in (200, 204, 94):
        for d in range(0, 29, 2):  # n - 4 shingles, of which a copy that begins d words later has all but d
            mark = [f"w{n}x{d}x{i}" for i in range(n + d)]
            rows += [(len(rows), " ".join(mark[:n])), (len(rows) + 1, " ".join(mark[d:]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.dedup_stage(spark, docs, str(tmp_path)).collect()}
    want = {percent: {d for d, (_, root) in brute.near_duplicates(rows, percent).items() if d == root} for percent in (80, 85)}
    assert kept == want[80] and len(want[80]) < len(want[85]) < len(rows)
    assert (1 - 0.8**pipeline.ROWS) ** pipeline.BANDS < 4e-8


@pytest.mark.parametrize("name, caught, wrong", [("sf0.001", 1, 1), ("sf0.01", 4, 3)])
def test_toxicity_on_held_out_labels_of_the_tables(spark, name, caught, wrong):
    path = f"/root/testdata/{name}"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = queries.op9_toxicity(spark, path).collect()
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert held.count((1, 1)) >= caught and held.count((0, 1)) <= wrong and len({r.score for r in rows}) > 1
    assert sum(r.predicted for r in rows) < 0.15 * len(rows)
