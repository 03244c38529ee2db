"""Operators that bring rows together: near-duplicates, packing, order, replies, the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillveil.llm import graph, neardup, order, packing, replies, tokens


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)].append(i)
    return {i: min(x for x in least[root(k)]) for k, (i, _) in enumerate(sets) if i is not None}


def near_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for g in range(12):
        base = list(rng.choice(words, 120))
        for c in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 7))):
                text[int(rng.integers(len(text)))] = f"x{rng.integers(1000)}"
            rows.append((n, " ".join(text)))
            n += 1
    shared_passage = " ".join(rng.choice(words, 60))
    rows += [(n + k, shared_passage + " " + " ".join(rng.choice(words, 50))) for k in range(15)]
    n += 15
    return rows + [(n, None), (n + 1, ""), (n + 2, "few words"), (n + 3, "Few  WORDS"), (n + 4, "a"), (n + 5, " ")]


def test_near_duplicates_equal_brute_force(documents):
    rows = near_rows()
    got = neardup.near_duplicates(documents(rows)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.drop_near_duplicates(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in want if want[i] == i) and kept.columns == documents(rows).columns


def test_near_duplicates_in_blocks(documents, monkeypatch):
    rows = near_rows()
    got = neardup.near_duplicates(documents(rows), block=3, block_shingles=300).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    kept = neardup.drop_near_duplicates(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*brute_components(rows).values()})


def hot_rows(n=160):
    """Copies of one text with 0 to 9 replaced words: many pairs on either side of the threshold, and long chains."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(n):
        text = list(base)
        for at in rng.choice(len(text), int(rng.integers(0, 10)), replace=False):
            text[at] = f"x{rng.integers(60)}"
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 16, "block_shingles": 2500}])
def test_near_duplicates_in_a_hot_group(documents, options):
    rows = hot_rows()
    want = brute_components(rows)
    assert 1 < len(set(want.values())) < len(rows)
    got = neardup.near_duplicates(documents(rows, extra=False), **options).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_forests_leave_buckets_and_clusters():
    """However many pairs a group has, fewer rows than its members leave it."""
    from tests.llm import test_groups as own

    texts = [t for _, t in own.hot_rows(300)]
    buf, off = neardup.K.utf8(neardup.pa.array(texts))
    values, first = neardup.shingle_sets(buf, off)
    n, regs, core = np.diff(first), neardup.set_sketches(values, first), np.zeros(len(texts), bool)
    forest = neardup._plausible_forest(core, n, regs, 0.75)
    assert len(forest) < len(texts)
    label = neardup._exact_labels(core, values, first, 75)
    want = own.brute_components(list(enumerate(texts)))
    assert {(int(label[i]), want[i]) for i in range(len(texts))} == {(int(label[i]), i) for i in set(want.values())}
    few = neardup._exact_labels(core, values, first, 75, cells=1000)
    assert np.array_equal(few, label)


def test_near_duplicates_of_very_long_texts(documents):
    rng = np.random.default_rng(9)
    long = [f"v{i}" for i in rng.integers(0, 50000, 120_000)]
    other = list(long)
    other[5000:6000] = ["new"] * 1000
    rows = [(4, " ".join(long)), (2, " ".join(other)), (1, " ".join(long[:60_000])), (9, "x " * 300_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(rows)).collect()}
    want = brute_components(rows)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in rows} and want[4] == 2


def test_near_duplicates_odd_rows(documents):
    text = " ".join(f"t{i}" for i in range(30))
    got = neardup.near_duplicates(documents([(None, text), (5, text), (5, text), (3, text), (None, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(3, 3, True), (5, 3, False), (5, 3, False)]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(documents([])).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(6)
    pool = rng.integers(1, 1 << 62, 4000).astype(np.uint64)
    for share in (0.3, 0.75, 0.9):
        errors = []
        for k in range(30):
            own = rng.permutation(pool)[:1000]
            common = int(2 * 500 * share / (1 + share))
            a, b = np.sort(own[:500]), np.sort(own[500 - common : 1000 - common])
            regs = neardup.set_sketches(np.concatenate([a, b]), np.array([0, 500, 1000]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            est, ok = neardup.plausible(np.array([(regs[0] > regs[1]).sum()]), np.array([(regs[0] < regs[1]).sum()]), np.array([500.0]), np.array([500.0]), 0.75)
            errors.append(est[0] - true)
            assert ok[0] or true < 0.75
        assert abs(np.mean(errors)) < 0.03
    both = neardup.set_sketches(np.concatenate([a, b, np.union1d(a, b)]), np.array([0, 500, 1000, 1000 + len(np.union1d(a, b))]))
    assert np.array_equal(np.maximum(both[0], both[1]), both[2])  # mergeable
    assert not neardup.set_sketches(np.zeros(0, np.uint64), np.array([0, 0])).any()


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(7)
    name = rng.permutation(200)
    edges = [(int(name[i]), int(name[i + 1])) for i in range(99)] + [(int(name[i]), int(name[i + 1])) for i in range(120, 150)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {int(name[i]): int(min(name[:100])) for i in range(100)} | {int(name[i]): int(min(name[120:151])) for i in range(120, 151)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.integers(1, 4), st.integers(0, 4))
def test_packer_places_every_id_once(sizes, windows, tolerance):
    packer = packing.Packer(32, windows, tolerance)
    out = []
    for d, n in enumerate(sizes):
        out += list(packer.add(d, np.arange(n) + 1000 * d))
        assert len(packer.open) <= windows
    out += list(packer.close())
    assert all(sum(len(p.ids) for p in w) <= 32 for w in out)
    at = sorted((p.doc, p.start, len(p.ids)) for w in out for p in w)
    for d, n in enumerate(sizes):
        end = 0
        for _, start, length in [x for x in at if x[0] == d]:
            assert start == end and length > 0
            end += length
        assert end == n
    assert all(np.array_equal(p.ids, np.arange(p.start, p.start + len(p.ids)) + 1000 * p.doc) for w in out for p in w)


def check_pieces(rows, pieces):
    ids = {i: np.append(x, 1) for (i, _), x in zip(rows, tokens.encoder().whole([t or "" for _, t in rows]), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, want in ids.items():
        own = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(by_doc[i], key=lambda p: p["start"])])
        assert np.array_equal(own, want) and all(p["doc_tokens"] == len(want) for p in by_doc[i])
    total = 0
    for own in by_sequence.values():
        end = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end <= 2048
        total += 0 if end & (end - 1) == 0 else 2048 - end
    return total / max(1, sum(map(len, ids.values())))


def test_packing_round_trip(spark, documents, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_pieces(rows, packing.pack(documents(rows)).collect()) < 0.02
    odd = [(1, None), (2, ""), (3, "one"), (4, "long " * 30000)]
    check_pieces(odd, packing.pack(documents(odd)).collect())
    assert packing.pack(documents([(7, "same"), (7, "same"), (None, "x")])).count() == 3
    assert packing.pack(documents([])).count() == 0


def test_packing_of_clashing_columns(documents):
    df = documents([(1, "one two"), (2, None)])
    for name in ("d", "t", "start", "ids", "offset", "length", "doc_tokens"):
        df = df.withColumn(name, F.lit("clash"))
    got = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in got] == [3, 1]


def test_feistel_is_a_permutation():
    for domain in (1, 2, 3, 10, 1000, 4097):
        x = order.feistel(np.arange(domain, dtype=np.uint64), domain, 9)
        assert sorted(x.tolist()) == list(range(domain))
    a, b = (order.feistel(np.arange(1000, dtype=np.uint64), 1000, k) for k in (1, 2))
    assert not np.array_equal(a, b) and abs(np.corrcoef(np.arange(1000), a.astype(float))[0, 1]) < 0.15


def plain_feistel(x, domain, key):
    """The permutation for one number, in plain integers."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for k in order.K.keyed(order.ROUNDS, key).tolist():
            mixed = int(order.K.mix(np.array([(right + k) % 2**64], np.uint64))[0])
            left, right = right, left ^ (mixed & ((1 << half) - 1))
        x = left << half | right
        if x < domain:
            return x


def test_training_order_round_trip(spark, documents, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    folder = f"file://{tmp_path}/shards"
    index = order.materialise(docs, folder, shard_rows=7).cache()
    rows = index.orderBy("slot").collect()
    n = len(rows)
    assert [r["slot"] for r in rows] == list(range(n)) and sorted(r["sequence_id"] for r in rows) == list(range(n))
    assert all(r["slot"] == plain_feistel(r["sequence_id"], n, 20240229) for r in rows)
    assert all((r["shard"], r["row"]) == (order.shard_name(r["slot"] // 7), r["slot"] % 7) for r in rows)
    read = list(order.read_from(folder, shard_rows=7))
    assert [s for s, _ in read] == list(range(n))
    resumed = list(order.read_from(folder, n // 2, shard_rows=7))
    assert resumed[0][0] == n // 2 and all(np.array_equal(x, y) for (_, x), (_, y) in zip(resumed, read[n // 2 :], strict=True))
    assert list(order.read_from(folder, n + 7, shard_rows=7)) == []
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sum(len(x) + 1 for x in tokens.encoder().whole([t or "" for _, t in texts]))
    assert sum(len(x) for _, x in read) == want == sum(r["n_tokens"] for r in rows)
    back = {r["slot"]: r for r in order.read_back(index, folder).collect()}
    assert all(back[s]["ids_crc32"] == zlib.crc32(x.astype("<u4").tobytes()) and back[s]["length"] == len(x) for s, x in read)
    assert {d for r in rows for d in r["doc_ids"]} == {i for i, _ in texts}
    again = order.materialise(docs, f"file://{tmp_path}/again", shard_rows=7, ranges=2)
    assert [tuple(r) for r in again.orderBy("slot").collect()] == [tuple(r) for r in rows]
    other = order.materialise(docs, f"file://{tmp_path}/other", key=1, shard_rows=7)
    assert [r["sequence_id"] for r in other.orderBy("slot").collect()] != [r["sequence_id"] for r in rows]
    assert [tuple(r)[:3] for r in order.manifest(index).collect()][1] == (order.shard_name(1), 7, 7)
    assert not list((tmp_path / "shards").glob(".*"))


def test_training_order_odd_rows(documents, tmp_path):
    rows = [(1, None), (None, ""), (3, "same text"), (3, "same text"), (4, "long " * 30_000)]
    index = order.materialise(documents(rows).coalesce(1), f"file://{tmp_path}/odd", shard_rows=4)
    read = [x for _, x in order.read_from(f"file://{tmp_path}/odd", shard_rows=4)]
    ids = [np.append(x, 1) for x in tokens.encoder().whole([t or "" for _, t in rows])]
    assert sum(map(len, read)) == sum(map(len, ids)) and sum(int((x == 1).sum()) for x in read) == len(rows)
    assert {d for r in index.collect() for d in r["doc_ids"]} == {1, None, 3, 4}
    assert order.materialise(documents([]), f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="don't fit into 1 bytes"):
        order.materialise(documents(rows), f"file://{tmp_path}/small", id_bytes=1)


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a b</s>"]), st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "<<SYS>>", "\\", " ", "a", "\n", "<", "["]), max_size=8).map("".join)), min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_template_reads_back(turns):
    text, mask = replies.render(turns)
    assert replies.parse(text) == turns
    assert [replies.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(70)] + [(2, 0, "user", None), (2, 0, "user", None), (3, 5, None, "x"), (None, 0, "user", "no id")]
    got = {r["conversation"]: r for r in replies.digests(replies.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 70, 2: 2, 3: 1, None: 1}
    assert got[1]["loss_chars"] == sum(len(f"text {t}") for t in range(1, 70, 2))
    assert replies.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_reply_tree_branches(spark):
    tree = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", -1.0), (1, 2, 0, "assistant", "good", 2.0), (1, 3, 2, "user", "more", 0.0), (1, 4, 3, "assistant", "end", 1.0), (1, 4, 3, "assistant", "end", 1.0), (1, 5, 1, "user", "alt", 1.0), (2, 0, 99, "user", "orphan", None), (3, 0, 1, "user", "loop", 0.0), (3, 1, 0, "user", "loop", 0.0)]
    df = spark.createDataFrame(tree, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got = {(r["conversation"], r["rank"]): replies.parse(r["formatted"]) for r in replies.format_reply_trees(df, branches=2).collect()}
    assert got == {
        (1, 1): [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")],
        (1, 2): [("user", "q"), ("assistant", "bad"), ("user", "alt")],
        (2, 1): [("user", "orphan")],
    }


def test_pipeline(spark, documents, tmp_path, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, seen = docs, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        kept = spark.read.parquet(path)
        seen.append(kept.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] == seen[4] > 0
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    check_pieces(rows, pipeline.STAGES[-1][1](spark, kept, sf).collect())
    assert pipeline.run(spark, sf).select(F.countDistinct("doc_id")).first()[0] == len(rows)


def test_estimate_drops_only_beyond_five_standard_deviations():
    sizes = np.full(2, 400.0)
    _, ok = neardup.plausible(np.array([48, 62]), np.array([47, 61]), sizes, sizes, 0.75)  # 161 and 133 equal registers, 192 expected
    assert ok.tolist() == [True, False]


def test_dropping_keeps_one_row_of_each_component(documents):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, one), (1, one), (2, one), (3, two), (2, three), (None, one), (None, one), (4, None)]
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(documents(rows)).collect()), key=str)
    assert left == sorted([(1, one), (3, two), (2, three), (None, one), (None, one), (4, None)], key=str)


def test_reply_trees_keep_messages_without_or_with_shared_ids(spark):
    tree = [(1, None, None, "user", "a", 0.0), (1, None, None, "user", "b", 0.0), (1, None, None, "user", "b", 0.0), (2, 0, None, "user", "x", 0.0), (2, 0, None, "user", "y", 1.0), (2, 1, 0, "assistant", "z", 0.0), (2, 1, 0, "assistant", "z", 0.0)]
    df = spark.createDataFrame(tree, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got = sorted((r["conversation"], replies.parse(r["formatted"])) for r in replies.format_reply_trees(df, branches=9).collect())
    assert got == [(1, [("user", "a")]), (1, [("user", "b")]), (1, [("user", "b")]), (2, [("user", "x")]), (2, [("user", "y"), ("assistant", "z")])]


def test_conversations_with_long_texts_and_more_columns(spark):
    long = "ha </s> " * 100_000
    rows = [(1, 1, "assistant", long, "clash"), (1, 0, "user", "say", "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string").withColumns({"parent": F.lit(1), "tie": F.lit("x"), "leaf": F.lit(2), "conversation": F.lit("y")})
    got = replies.digests(replies.format_conversations(df)).first()
    assert (got["conversation"], got["n_turns"], got["loss_chars"]) == (1, 2, len(long))
    tree = df.withColumns({"node_id": F.col("turn"), "parent_id": F.when(F.col("turn") > 0, F.col("turn") - 1), "score": F.lit(1.0), "rank": F.lit("z")})
    (one,) = replies.format_reply_trees(tree).collect()
    assert replies.parse(one["formatted"]) == [("user", "say"), ("assistant", long)]
    assert replies.format_reply_trees(tree.limit(0)).count() == 0


def test_ties_of_turns_go_by_role_then_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (None, None, None, "y"), (None, None, None, "x"), (1, 0, "user", None)]
    got = {r["conversation"]: replies.parse(r["formatted"]) for r in replies.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: [("assistant", "c"), ("user", ""), ("user", "a"), ("user", "b")], None: [("", "x"), ("", "y")]}


def test_pipeline_of_odd_rows(spark, documents, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(12)

    def text(n):
        return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))

    a, b, long = text(80), text(90), text(60_000)
    leaked = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, None), (4, ""), (5, long), (6, text(70) + " password=hunter2hunter2"), (7, f"{text(60)} {leaked}"), (6, text(75))]
    kept, left = documents(rows, extra=False), []
    for _, stage in pipeline.STAGES[:-1]:
        kept = neardup.shared.table(stage(spark, kept, sf))
        left.append(sorted(((r["doc_id"], len(r["text"])) for r in kept.collect()), key=str))
    size = {i: len(t or "") for i, t in rows}
    assert left[0] == sorted([(i, len(t)) for i, t in rows if t], key=str)
    assert left[1] == sorted([(1, len(a)), (None, len(b)), (None, len(b)), (5, len(long)), *((i, len(t)) for i, t in rows if i in (6, 7))], key=str)
    assert left[2] == [x for x in left[1] if x != (7, size[7])] and len(left[3]) == len(left[2])
    assert not any("hunter2" in r["text"] for r in kept.collect())
    pieces = pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {p["doc_id"] for p in pieces} == {1, None, 5, 6}
    empty = documents([], extra=False)
    for _, stage in pipeline.STAGES[:-1]:
        empty = stage(spark, empty, sf)
        assert empty.columns == kept.columns and empty.count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_long_runs_of_backslashes(spark):
    import time

    slashes = "\\" * 1_000_000
    turns = [("user", slashes), ("assistant", f"{slashes}[INST] x {slashes}"), ("user", "\\\\</s>\\"), ("user", f"{slashes}</s>")]
    began = time.thread_time()
    text, mask = replies.render(turns)
    assert replies.parse(text) == turns and [replies.unescape(text[a:b]) for a, b in mask] == [turns[1][1]]
    assert time.thread_time() - began < 10
    rows = [(1, 0, "user", slashes), (1, 1, "assistant", f"{slashes}</s>"), (1, 1, "assistant", f"{slashes}</s>")]
    got = replies.digests(replies.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert (got["n_turns"], got["loss_chars"]) == (3, 2 * (len(slashes) + 4))  # repeated rows are turns of their own
