import importlib
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark, prose):
    bad = ("stupid", "moron", "idiot", "worthless")
    rows, labels = [], []
    for k in range(600):
        w = prose(k, 60).split()
        toxic = k % 5 == 0
        if toxic:
            for j in range(3):
                w[5 + 17 * j] = bad[(k // 5 + j) % 4]
        rows.append((k, " ".join(w), "en", "s", 0, "x"))
        if k % 3:
            labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_disguises(spark, labelled):
    docs, labels = labelled
    extra = [(9001, "the m0r0n and st.up.id w0rthle$$s one"), (9002, "a s t u p i d wooorthless 1d10t here"), (9003, None), (9004, ""), (9005, "calm words about the weather")]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in toxicity.judge(spark, more, labels).collect()}
    assert len(got) == 605
    held = [r for i, r in got.items() if i < 600 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(r.held_out for r in held) and not any(r.held_out for i, r in got.items() if zlib.crc32(str(i).encode()) % 4 != 2)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.98
    assert got[9002].predicted == 1 and got[9001].score > got[9005].score
    assert got[9003].score == got[9004].score and got[9005].predicted == 0


def test_readings_of_disguised_words(spark, labelled):
    model = toxicity.CharModel.of(toxicity.char_counts(labelled[0]))
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("moooron", "moron"), ("wor-th-less", "worthless")):
        assert word in toxicity.readings(token, model), token
    buf = np.frombuffer(b"plain words 1d10t and i d i o t stuuupid a.b.c.d x", np.uint8)
    assert [t for _, t in toxicity.suspects(buf, np.array([0, len(buf)]))] == ["1d10t", "stuuupid", "a.b.c.d", "idiot"]


def test_disguises_that_stand_alone(spark, labelled):
    """Words set apart next to other single letters or words, look-alikes at the end, runs of separators."""
    model = toxicity.CharModel.of(toxicity.char_counts(labelled[0]))

    def read(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return {w for _, token, spaced in toxicity.disguised(buf, np.array([0, len(buf)])) for r in toxicity.readings(token, model, spaced=spaced) for w in r.split()}

    for text, *found in (("a s t u p i d", "stupid"), ("s t u p i d i d i o t", "stupid", "idiot"), ("an idi07 here", "idiot"), ("1d10t!", "idiot"), ("s..t..u..p..i..d", "stupid"), ("s - t - u -- p - i - d", "stupid"), ("s__t__u.p.i.d", "stupid")):
        assert set(found) <= read(text), text
    assert not read("plain words, 2024 and 3.14 - or 10 000 - stay as they are. - so")
    docs, labels = labelled
    extra = [(9100, "a s t u p i d"), (9101, "s t u p i d i d i o t"), (9102, "idi07"), (9103, "s..t..u..p..i..d"), (9104, "s - t - u - p - i - d"), (9105, "calm"), (9106, "s t u p i d i d i o t with m..o..r..o..n")]
    got = {r.doc_id: r for r in toxicity.judge(spark, docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True), labels).where("doc_id > 9000").collect()}
    assert all(got[i].score > 2 * got[9105].score for i in range(9100, 9105)) and got[9105].predicted == 0 and got[9106].predicted == 1


def test_clean_keeps_columns(spark, labelled):
    docs, labels = labelled
    kept = toxicity.clean(spark, docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(0, 600, 5))) < 5 and len(ids) > 470


def test_no_labels_and_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.judge(spark, corpus, none).collect()
    assert len(got) == corpus.count() and len({r.score for r in got}) == 1 and not any(r.predicted for r in got)
    assert toxicity.judge(spark, corpus.limit(0), none).count() == 0


def test_pipeline_stages_in_turn(spark, tmp_path, prose, labelled):
    """Each stage takes effect; the whole agrees with the stages run one by one."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs, labels = labelled
    rows = [(10_000, prose(3, 60), "en", "t", 0, None), (10_001, prose(7001, 30) + " " + prose(7002, 20), "fr", None, 0, None), (10_002, prose(7003, 5), "fr", None, 0, None), (10_003, None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(7001, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    at, seen = docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns + (["shard"] if k == 4 else [])
        out.write.parquet(f"{tmp_path}/stage{k}")
        at = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id for r in at.collect()})
    assert 5 not in seen[0] and 1 in seen[0]
    assert 10_000 in seen[0] and 10_000 not in seen[1] and 3 in seen[1]  # a copy of document 3
    assert 10_001 in seen[1] and 10_001 not in seen[2]
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    whole = pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.shard) for r in df.collect())
    assert key(whole) == key(at)


def test_readings_are_the_best_of_all(spark, labelled):
    """Against an exhaustive decode of the lattice."""
    import itertools

    model = toxicity.CharModel.of(toxicity.char_counts(labelled[0]))

    def value(text):
        a = b = toxicity._EDGE
        total = 0.0
        for c in text:
            k = toxicity._EDGE if c == " " else ord(c) - 97 if "a" <= c <= "z" else toxicity._OTHER
            total += model.logp[a, b, k]
            a, b = b, k
        return total + model.logp[a, b, toxicity._EDGE]

    for token, spaced in (("1d10t", False), ("m**ron", False), ("st.uup1d", False), ("aid10t", True), ("$tup1", True), ("xx77", False)):
        steps = toxicity.lattice(token)
        best = {}
        for path in itertools.product(*steps):
            cost = sum(c for _, c in path)
            parts = [x for x, _ in path]
            gaps = itertools.product(("", " "), repeat=len(parts) - 1) if spaced else [("",) * (len(parts) - 1)]
            for gap in gaps:
                text = parts[0] + "".join(g + x for g, x in zip(gap, parts[1:], strict=True))
                if text and "  " not in text and not text.startswith(" "):
                    best[text] = max(best.get(text, -1e300), cost + value(text))
        want = sorted((-v, t) for t, v in best.items())[:3]
        got = toxicity.readings(token, model, spaced=spaced)
        assert [round(best[t], 9) for t in got] == [round(-v, 9) for v, _ in want], token


def test_score_is_that_of_the_features(spark, labelled):
    docs, labels = labelled
    scorer = toxicity.learn(spark, docs, labels)
    got = {r.doc_id: r.score for r in toxicity.judge(spark, docs, labels).collect()}
    weight = dict(zip(scorer.hashes.tolist(), scorer.weights.tolist(), strict=True))
    for r in docs.limit(40).collect():
        buf = np.frombuffer(r.text.encode(), np.uint8)
        _, x = toxicity.features(buf, np.array([0, len(buf)]), scorer.model, {})
        z = scorer.bias + sum(weight.get(h, 0.0) for h in set(x.tolist()))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_minimum_of_a_convex_function():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 6))
    h, b = a.T @ a, rng.normal(size=6)
    w = toxicity.minimum(lambda w: (float(0.5 * w @ h @ w - b @ w), h @ w - b), np.zeros(6))
    assert np.allclose(w, np.linalg.solve(h, b), atol=1e-5)


def test_long_spaced_text_takes_time_in_proportion(spark, labelled):
    import time

    model = toxicity.CharModel.of(toxicity.char_counts(labelled[0]))
    took = []
    for n in (4000, 16000):
        start = time.process_time()
        found = toxicity.readings("stupid" * (n // 6), model, spaced=True)
        took.append(time.process_time() - start)
        assert len(found[0].replace(" ", "")) == n // 6 * 6
    assert took[1] < 8 * took[0] + 0.5, took


def test_columns_of_the_input_may_have_any_name(spark, labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    odd = docs.select("doc_id", "text", F.lit(1).alias("__text"), F.lit(2).alias("__score"), F.lit(3).alias("__predicted"), F.lit("p").alias("predicted"), F.lit("s").alias("Score"))
    kept = toxicity.clean(spark, odd, labels)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert kept.select("__score", "__predicted", "predicted", "Score").distinct().collect() == [(2, 3, "p", "s")]
