"""SimHash fingerprints and classes against brute force."""

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from leadflow.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, n string, class_fp string"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(points, ids, bits):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(points)):
        for j in range(i):
            if bin(int(points[i]) ^ int(points[j])).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(points)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return [least[find(i)] for i in range(len(points))]


def texts(n, rng):
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, rng.integers(1, 300))) for _ in range(n)]
    near = []
    for b in base[: n // 2]:
        c = list(b)
        c[int(rng.integers(len(c)))] = "changed"
        near.append(c)
    return [" ".join(x) for x in base + near]


def check(spark, rows, bits=2):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_digest(df, max_bits=bits).collect()), key=repr)
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps, [i for i, _ in rows], bits)
    assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp)), key=repr)


def test_edge_cases(spark):
    check(spark, [(5, None), (9, ""), (7, " \t\n"), (1, "One Two"), (2, "one\x0btwo"), (3, "É é"), (4, "é É"), (None, "one two"),
                  (None, "alone " * 9), (6, "a b c " * 20000), (6, "a b c " * 20000), (8, "a b c")])


def test_random_texts_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 40)
    monkeypatch.setattr(S, "CELL_ROWS", 8)
    rng = np.random.default_rng(3)
    check(spark, list(enumerate(texts(150, rng))))


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_tree_finds_every_link(bits, monkeypatch):
    """Clusters with chains, dense balls and noise: shard forests together give the brute components."""
    monkeypatch.setattr(S, "CELL_ROWS", 16)
    rng = np.random.default_rng(bits)
    points = [int(x) for x in rng.integers(0, 2**63, 120)]
    for centre in points[:10]:
        at = centre
        for _ in range(15):
            at ^= 1 << int(rng.integers(64))
            points.append(at if rng.random() < 0.7 else centre ^ (1 << int(rng.integers(64))))
    points = np.unique(np.array(points, np.uint64))
    tree = S.build_tree(points[::2], 20, bits)
    assert tree.leaves > 1
    shard, at = S.route(tree, points, bits)
    edges = []
    for leaf in range(tree.leaves):
        p = np.sort(points[at[shard == leaf]])
        edges += [(int(p[i]), int(p[r])) for i, r in enumerate(S.forest(p, bits)) if r != i]
    root = {int(p): int(p) for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        assert bin(a ^ b).count("1") >= 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert [find(int(p)) for p in points] == brute_components(points, [int(p) for p in points], bits)


def test_components_contract_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 7), (5, 5)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 41 + 30


def test_one_document_of_each_class(spark):
    df = spark.createDataFrame([(3, "a b c d", "k"), (2, "a b c d", "k"), (2, "a b c d", "k"), (7, None, "k"), (8, "", "k"),
                                (None, "other words stand here", "k"), (9, None, None)], "doc_id long, text string, row string")
    out = S.one_per_class(df)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:2] for r in out.collect()), key=repr) == sorted(
        [(2, "a b c d"), (7, None), (None, "other words stand here")], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.simhash_digest(empty).collect() == [] and S.one_per_class(empty).collect() == []


def test_a_dense_ball_is_compared_in_several_tasks(spark, monkeypatch):
    """Fingerprints within five flips of one centre: no vantage point divides them."""
    monkeypatch.setattr(S, "SHARD_ROWS", 300)
    rng = np.random.default_rng(3)
    centre, found = 0x123456789ABCDEF0, set()
    while len(found) < 2000:
        found.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    fps = sorted(found)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    points = S.materialise(spark.createDataFrame([(f,) for f in signed], "fp long"), "ball")
    assert len(S.build_tree(np.array(fps, np.uint64), 300, 2).vantage) == 0                # one leaf
    routed = points.select(F.lit(0).cast("long").alias("shard"), "fp")
    tasks = S.in_block_pairs(routed).groupBy("i", "j").count().collect()
    assert len(tasks) == 21 and max(r["count"] for r in tasks) < 1000                     # 7 blocks, in pairs
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in S.components(S.shard_links(points, 2)).collect()}
    comp = brute_components(fps, fps, 2)
    groups = {}
    for f, c in zip(fps, comp):
        groups.setdefault(c, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values())) and len(groups) < 2000
