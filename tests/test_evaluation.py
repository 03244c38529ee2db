import json
import os
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillveil.operators import cache, detection, evaluation, ner
from quillveil.operators.spans import Span

SCHEMA = "doc long, entity_type string, start int, end int"


def iou(a, b):
    both = min(a[1], b[1]) - max(a[0], b[0])
    return max(0, both) / (max(a[1], b[1]) - min(a[0], b[0]))


def test_counts_are_those_of_a_maximum_matching(spark):
    rng = random.Random(4)
    gold, predicted, want = [], [], {}
    for doc in range(40):
        gs = [(a := rng.randrange(12), a + rng.randrange(2, 8)) for _ in range(rng.randrange(0, 4))]
        ps = [(a := rng.randrange(12), a + rng.randrange(2, 8)) for _ in range(rng.randrange(0, 5))]
        gold += [(doc, "A", *g) for g in gs]
        predicted += [(doc, "A", *p) for p in ps]
        best = max((sum(iou(g, p) >= 0.5 for g, p in zip(gs, order, strict=False)) for order in permutations(ps + [(99, 100)] * len(gs), len(gs))), default=0)
        if gs or ps:
            want[doc] = (best, len(ps) - best, len(gs) - best)
    counts = evaluation.match_counts(spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(predicted, SCHEMA), ["doc"])
    assert {r["doc"]: (r["tp"], r["fp"], r["fn"]) for r in counts.collect()} == want
    row = evaluation.scores(counts).first()
    tp, fp, fn = (sum(x[k] for x in want.values()) for k in range(3))
    assert row["precision"] == pytest.approx(tp / (tp + fp)) and row["recall"] == pytest.approx(tp / (tp + fn))
    assert evaluation.summary(counts, ["A"]).first()["tier_1_recall"] == pytest.approx(tp / (tp + fn))
    assert evaluation.failing(evaluation.scores(counts), ["A"], 1.1).count() == 1


def test_coverage_over_masking_and_leaks(spark):
    gold = spark.createDataFrame([(1, "A", 0, 10), (1, "B", 20, 30)], SCHEMA)
    found = spark.createDataFrame([(1, "B", 0, 9), (1, "A", 24, 40), (2, "A", 0, 5)], SCHEMA)
    covered = {r["start"]: r["covered"] for r in evaluation.coverage(gold, found, ["doc"], ["A", "B"]).collect()}
    assert covered == {0: True, 20: False}
    assert {r["entity_type"]: (r["on_gold"], r["total"]) for r in evaluation.over_masking(gold, found, ["doc"], ["A", "B"]).collect()} == {"A": (0, 2), "B": (1, 1)}
    texts = spark.createDataFrame([(1, "Ann Texier xx or someone yy")], "doc long, text string")
    words = evaluation.unmasked_words(texts, spark.createDataFrame([(1, "P", 0, 10)], SCHEMA), spark.createDataFrame([(1, "P", 0, 5)], SCHEMA), ["doc"])
    assert [(r["word"], r["place"]) for r in words.collect()] == [("Texier", 4)]
    leaks = evaluation.leaks_against(spark.createDataFrame([("A", "x")], "entity_type string, value string"), spark.createDataFrame([("A", "y")], "entity_type string, value string"))
    assert {(r["value"], r["side"]) for r in leaks.collect()} == {("x", "new"), ("y", "gone")}
    samples = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "name string, ms double")
    assert evaluation.percentiles(samples, ["name"], "ms").first()["p95"] == 95


def test_windows():
    text = "\n\n".join("word " * 60 for _ in range(20))
    cut = ner.chunks(text)
    assert all(text[o : o + len(c)] == c and len(c) <= 1200 for o, c in cut) and cut[-1][0] + len(cut[-1][1]) == len(text)
    assert all(a[0] + len(a[1]) > b[0] > a[0] for a, b in zip(cut, cut[1:], strict=False))
    assert ner.chunks("") == [] and ner.chunks("x" * 3000)[1][0] == 1000
    assert ner.token_windows([(i, i + 1) for i in range(100)], 40, 10) == [(0, 40), (30, 70), (60, 100)]
    got = ner.passes()
    assert [(p.tier, len(p.labels), p.threshold) for p in got] == [(2, 3, 0.5), (2, 1, 0.5), (3, 11, 0.2)]


def test_recognizer_with_a_stub_model(spark):
    def model(texts, labels, threshold):
        return [[(t.index("Ann"), t.index("Ann") + 3, "person", 1.0)] if "person" in labels and "Ann" in t else [] for t in texts]

    from quillveil.operators.detection import detect

    df = spark.createDataFrame([(1, "Hi Ann, a@x.com"), (2, None)], "id long, text string")
    rows = {r["id"]: r["spans"] for r in detect(df, recognizers=(ner.recognizer(model),), specificity={t.entity_type: t.specificity for t in ner.TYPES}).collect()}
    assert [(s["entity_type"], s["start"], s["confidence"]) for s in rows[1]] == [("PERSON", 3, 0.99), ("EMAIL", 8, 0.95)] and rows[2] == []


def test_trimming_and_contested():
    kind = ner.Type("PERSON", "person", 0.5, 2, 30, frozenset({"patient", "dr"}), frozenset({"le"}), outranks_tier_3_below=0.3)
    text = "le patient Dr. Martin"
    assert ner.trimmed(text, 0, len(text), kind) == 15
    assert ner.trimmed("Alexander Karz", 6, 14, kind) == 6 and ner.trimmed("der patient", 0, 11, kind, begins=False) == 0
    assert ner.trimmed("Le Thi Mai", 0, 10, kind) == 0 and ner.trimmed("patient", 0, 7, kind) == 0 and ner.trimmed("patient !", 0, 9, kind) == 0
    weak, strong = Span("HEALTH", 0, 9, 0.25, "ner", 3), Span("PERSON", 4, 12, 0.9, "ner", 2)
    assert ner.contested([weak, strong], [kind]) == [strong._replace(start=0, end=9), strong]
    for bad in ([kind, kind], [kind._replace(tier=4)], [kind._replace(label="")], [kind._replace(threshold=2)], [kind._replace(tier=3)], [kind._replace(trim=frozenset({"a b"}))], [kind._replace(specificity=-1)]):
        with pytest.raises(ValueError):
            ner.check(bad)
    assert ner.availability("auto", False, True) == (False, "no weights") and ner.availability("off", True, True) == (False, "disabled")
    with pytest.raises(RuntimeError):
        ner.availability("required", True, False)


def test_buckets_bootstrap_frontier_and_metrics(spark):
    covered = spark.createDataFrame([("fr", "A", True), ("fr", "A", False), ("de", "A", False), ("de", "B", True)], "lang string, entity_type string, covered boolean")
    rows = {(r["lang"], r["entity_type"]): (r["covered"], r["gold"], r["ratio"], r["dark"]) for r in evaluation.covered_buckets(covered, ["lang", "entity_type"]).collect()}
    assert rows == {("fr", "A"): (1, 2, 0.5, False), ("de", "A"): (0, 1, 0.0, True), ("de", "B"): (1, 1, 1.0, False), (None, None): (2, 4, 0.5, False)}
    measured = [(g, arm, n) for g in range(30) for arm, n in (("good", 5 + g % 3), ("bad", 4 + g % 3), ("same", 5 + g % 3))]
    df = spark.createDataFrame(measured, "doc long, arm string, n long")
    got = {r["arm"]: (r["wins"], r["undecided"]) for r in evaluation.bootstrap(df, "doc", "arm", "n", 200).collect()}
    assert got == {"good": (0, 200), "bad": (0, 200), "same": (0, 200)}
    apart = df.where("arm <> 'same'")
    one = {r["arm"]: r["wins"] for r in evaluation.bootstrap(apart, "doc", "arm", "n", 200).collect()}
    assert one == {"good": 200, "bad": 0} == {r["arm"]: r["wins"] for r in evaluation.bootstrap(apart.repartition(5), "doc", "arm", "n", 200).collect()}
    close = spark.createDataFrame([(g, arm, g % 7 if arm == "a" else (g + 3) % 7) for g in range(40) for arm in "ab"], "doc long, arm string, n long")
    wins = {r["arm"]: r["wins"] for r in evaluation.bootstrap(close, "doc", "arm", "n", 300).collect()}
    assert 30 < wins["a"] < 270 and wins["a"] + wins["b"] <= 300
    shapes = spark.createDataFrame([("x", 5, 2), ("y", 5, 3), ("z", 6, 4), ("v", 5, 2)], "shape string, found int, over_masked int")
    assert {r["shape"]: r["dominated"] for r in evaluation.frontier(shapes).collect()} == {"x": False, "y": True, "z": False, "v": False}
    spans = spark.createDataFrame([([1, 2, 3], [2])], "together array<int>, apart array<int>")
    assert spans.select(evaluation.lost(F.col("together"), F.col("apart"))).first()[0] == [1, 3]
    counts = spark.createDataFrame([("A", 3, 1, 0)], "entity_type string, tp long, fp long, fn long")
    told = json.loads(evaluation.metrics(evaluation.scores(counts), evaluation.summary(counts, ["A"]), corpus_sha256="x"))
    assert told["per_type"]["A"]["precision"] == 0.75 and told["total"]["tier_1_recall"] == 1.0 and told["corpus_sha256"] == "x"


def test_cache(spark):
    df = spark.createDataFrame([(1, "t", "a@x.com"), (2, "t", "a@x.com"), (3, "u", "a@x.com"), (4, "t", None), (5, None, "b@x.com")], "id long, tenant string, text string")
    first, kept = cache.detect_cached(df, cache.empty(spark), b"salt", "tenant")
    assert {r["id"]: len(r["spans"]) for r in first.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1} and kept.count() == 3
    assert {r["id"]: r["hit"] for r in cache.probe(df, kept, b"salt", "tenant").collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert cache.probe(df, kept, b"other", "tenant").where("hit").count() == 0 and cache.probe(df, kept, b"salt", "tenant", version="x").where("hit").count() == 0
    again, same = cache.detect_cached(df, kept, b"salt", "tenant")
    assert again.count() == 5 and same.count() == 3 and cache.sweep(kept, detection.version()).count() == 3 and cache.sweep(kept, "x").count() == 0
    assert not any("x.com" in str(r) for r in kept.drop("spans").collect())


def test_cache_store(spark, tmp_path):
    store = cache.Store(spark, f"file://{tmp_path}/store")
    assert store.rows().count() == 0 and store.merge() == 0 and store.sweep() is None
    df = spark.createDataFrame([(i, f"t{i % 3}", f"mail a{i % 50}@x.com") for i in range(200)] + [(200, "t0", None), (201, None, "b@x.com"), (202, "t1", "")], "id int, tenant string, text string")

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}

    first = store.detect(df.where("id < 30"), b"salt", "tenant")
    assert {r["id"]: len(r["spans"]) for r in first.collect()} == dict.fromkeys(range(30), 1)
    before = files()
    again = {r["id"]: len(r["spans"]) for r in store.detect(df, b"salt", "tenant").collect()}
    assert again == dict.fromkeys(range(202), 1) | {200: 0, 202: 0} and store.rows().count() == 152
    assert before.items() <= files().items()  # nothing that was there is written again
    after = files()
    store.detect(df, b"salt", "tenant")
    assert files() == after and cache.probe(df, store.rows(), b"salt", "tenant").where("not hit").count() == 1
    store.detect(df.where("id < 5"), b"salt", "tenant", version="other")
    assert store.rows("other").count() == 5 and store.rows().count() == 152
    crowded = {os.path.basename(d) for d, _, names in os.walk(tmp_path / f"store/version={detection.version()}") if sum(n.endswith(".parquet") for n in names) > 1}
    untouched = {f: t for f, t in files().items() if f.parent.name not in crowded}
    assert crowded and untouched and store.merge(most_files=1) == len(crowded) and store.rows().count() == 152 and store.merge(most_files=1) == 0
    assert untouched.items() <= files().items()
    store.sweep()
    assert store.rows("other").count() == 0 and store.rows().count() == 152


def test_token_windows_reach_the_model():
    seen = []

    def model(texts, labels, threshold):
        seen.extend(texts)
        return [[(m.start(), m.end(), "person", 0.9) for m in re.finditer("Ann", t)] if "person" in labels else [] for t in texts]

    def offsets(text):
        return [m.span() for m in re.finditer(r"\S+", text)]

    text = "word " * 90 + "Ann " + "word " * 200
    spans = ner.recognizer(model, offsets=offsets, budget=ner.TOKEN_RESERVE + 80)(text)
    assert {(s.start, s.end) for s in spans} == {(450, 453)} and max(len(t.split()) for t in seen) == 80
    assert [text[o : o + len(w)] for o, w in ner.windows(text, offsets=offsets, budget=80)] == [w for _, w in ner.windows(text, offsets=offsets, budget=80)]


def test_types_of_a_catalog():
    entry = {"entity_type": "PERSON", "label": "person", "threshold": 0.5, "tier": 2, "specificity": 30, "trim_leading": ["dr"], "own_pass": True}
    (kind,) = ner.types_of([entry])
    assert kind.trim == {"dr"} and kind.own_pass and kind.outranks_tier_3_below is None
    for wrong in (entry | {"odd": 1}, {k: v for k, v in entry.items() if k != "threshold"}, entry | {"threshold": True}):
        with pytest.raises(ValueError):
            ner.types_of([wrong])


def test_rivals_keep_their_recognizer_and_need_no_more_confidence():
    kind = ner.Type("X", "x", 0.1, 2, 30, outranks_tier_3_below=0.5)
    weak, rival = Span("HEALTH", 0, 9, 0.4, "one", 3), Span("X", 4, 12, 0.2, "two", 2)
    assert ner.contested([weak, rival], [kind])[0] == Span("X", 0, 9, 0.2, "one", 2)


def test_ways_of_asking(spark):
    rng = random.Random(3)
    gold = [(d, kind, a, a + 4) for d in range(6) for a in (0, 10, 20) for kind in ("PERSON", "ORG")[: 1 + d % 2]]
    answers = [(rng.randrange(6), rng.choice("xy"), a := rng.randrange(30), a + rng.randrange(1, 9), rng.choice([None, 0.3, 0.4, 0.5, 0.6, 0.995]), rng.choice([0.05, 0.5, 0.95])) for _ in range(300)]
    calls = [("x", 1.5), ("x", 0.5), ("y", 1.0), ("z", 3.0)]
    frames = spark.createDataFrame(gold + gold[:3], SCHEMA), spark.createDataFrame(answers, "doc long, shape string, start int, end int, score double, threshold double"), spark.createDataFrame(calls, "shape string, seconds double")
    got = {(r["shape"], r["offset"]): (r["found"], r["over_masked"], r["elapsed"], r["dominates"]) for r in evaluation.dominating(evaluation.asked(*frames, ["doc"]), "x").collect()}
    want = {}
    for shape in "xyz":
        for offset in evaluation.OFFSETS:
            said = [a for a in answers if a[1] == shape and a[4] is not None and a[4] >= round(max(0.01, min(0.99, a[5] + offset)), 9)]
            found = sum(any(a[0] == g[0] and a[2] <= g[2] and a[3] >= g[3] for a in said) for g in gold)
            over = sum(not any(a[0] == g[0] and a[2] < g[3] and g[2] < a[3] for g in gold) for a in said)
            want[shape, offset] = found, over, {"x": 2.0, "y": 1.0, "z": 3.0}[shape]
    assert {k: v[:3] for k, v in got.items()} == want
    assert {k: v[3] for k, v in got.items()} == {k: k[0] != "x" and v[0] >= want["x", 0.0][0] and v[1] <= want["x", 0.0][1] for k, v in want.items()}
    assert evaluation.asked(frames[0].limit(0), frames[1].limit(0), frames[2].limit(0), ["doc"]).count() == 0
    assert not evaluation.dominating(evaluation.asked(*frames, ["doc"]), "none").where("dominates").count()


def test_spans_of_one_key_are_matched_chain_by_chain(spark, monkeypatch):
    pick = random.Random(3)

    def some():
        return [(d, pick.choice(["A", "B"]), a, a + pick.randrange(1, 6)) for d in (1, 2) for a in (pick.randrange(150) for _ in range(80))]

    gold, predicted = (spark.createDataFrame(some(), "doc int, entity_type string, start int, `end` int") for _ in range(2))
    whole = evaluation.match_counts(gold, predicted, ["doc"]).collect()
    monkeypatch.setattr(evaluation, "ONE_CHAIN", 0)
    cut = evaluation.match_counts(gold, predicted, ["doc"])
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole))
