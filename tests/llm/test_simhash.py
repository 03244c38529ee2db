"""SimHash near-duplicates against plain Python."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillveil.llm import simhash
from quillveil.llm import textkit as K


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """component by row number, from (id, fingerprint)."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def packed(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


@given(st.lists(st.text("aBé中 \t\n ", max_size=60), max_size=8))
@settings(max_examples=80, deadline=None)
def test_fingerprints(texts):
    assert simhash.fingerprints(*packed(texts)).tolist() == [plain_fingerprint(t) for t in texts]


def test_fingerprints_in_pieces(monkeypatch):
    text = " ".join(f"Word{i * i % 37}" for i in range(1000))
    whole = simhash.fingerprints(*packed([text, "a b", text + " x"]))
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprints(*packed([text, "a b", text + " x"])).tolist() == whole.tolist() == [plain_fingerprint(t) for t in (text, "a b", text + " x")]


def families(n, seed, flips=9):
    """Points of which many are a few bits from each other."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, n // 8 + 1, np.uint64)
    points = centres[rng.integers(0, len(centres), n)]
    for _ in range(flips):
        points ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) * (rng.random(n) < 0.5)
    return np.unique(points)


@pytest.mark.parametrize("leaves", [1, 2, 13, 60])
def test_trees_meet_every_pair(leaves):
    points = families(1500, leaves)
    met = set()
    for mask in simhash.MASKS:
        tree = simhash.build(points[::3], mask, leaves)
        leaf, at, home = simhash.route(tree, points)
        assert np.bincount(at[home], minlength=len(points)).tolist() == [1] * len(points)
        for x in np.unique(leaf):
            own, all_ = at[(leaf == x) & home], at[leaf == x]
            a, b = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[all_][None, :]) <= simhash.DISTANCE)
            met |= set(zip(np.minimum(own[a], all_[b]).tolist(), np.maximum(own[a], all_[b]).tolist(), strict=True))
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= simhash.DISTANCE))
    assert met == set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("cells", [64, 4096, 1 << 20])
def test_shards_join_every_link(cells):
    points = families(900, cells)
    label = simhash.linked_in_shard(points, np.ones(len(points), bool), simhash.WHOLE ^ simhash.WHOLE, cells)  # a mask of no bits separates nothing
    expected = plain_components([(i, int(p)) for i, p in enumerate(points)])
    assert [expected[x] for x in label] == expected and len(set(label.tolist())) == len(set(expected))


def rows_for(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(160):
        if i % 4 and out:
            t = out[int(rng.integers(0, len(out)))][1].split(" ")
            if i % 4 == 2:
                t[int(rng.integers(0, len(t)))] = "changed"
            out.append((i, " ".join(t)))
        else:
            out.append((i, " ".join(rng.choice(words, int(rng.integers(1, 400))))))
    return out


def test_components(spark, documents, monkeypatch):
    rows = rows_for(5)
    rows += [(500, None), (501, ""), (502, " \t"), (503, "a " * 70_000), (503, "a " * 70_000), (None, rows[0][1]), (None, "only one without an id"), (504, rows[3][1].upper()), (505, "one")]
    prints = [plain_fingerprint(t) if len(t or "") < 10**5 else plain_fingerprint("a a a a") for _, t in rows]
    expected = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, prints, plain_components([(d, f) for (d, _), f in zip(rows, prints, strict=True)]), strict=True)), key=str)
    for sample, home, block in ((1 << 16, 1 << 13, 1 << 16), (32, 8, 16)):
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (home, block))
        got = simhash.simhash_components(documents(rows).withColumnRenamed("lang", "fp")).collect()
        assert sorted((tuple(r) for r in got), key=str) == expected


def test_empty_table(spark, documents):
    got = simhash.simhash_components(documents([]))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


def test_copies_of_one_text(spark, documents):
    got = simhash.simhash_components(documents([(i, "the same text in all rows") for i in range(50, 3000)])).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [50]


def test_whole_table(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    expected = sorted((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints), strict=True))
    assert sorted(tuple(r) for r in simhash.op11_simhash(spark, sf).select("doc_id", "fingerprint", F.col("component_id")).collect()) == expected
