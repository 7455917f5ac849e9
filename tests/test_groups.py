"""Hash arithmetic, near-duplicate pairs, components, groups, and skewed joins."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkcurate.functions import hashing as H
from sparkcurate.operators import grouping as G
from sparkcurate.operators.components import connected_components, contract
from sparkcurate.operators import ranking
from sparkcurate.operators.ranking import hash_rank, into_buckets, prefix_scan
from sparkcurate.operators.skew import attach


def test_sweep_takes_any_ids(spark):
    """Ids over the whole range of 64 bits: a node number and a level must not overflow."""
    rows = [(i, [h], "train" if i % 3 else "test", "healthy") for i, h in enumerate(planted(60, 4))]
    small = spark.createDataFrame(rows, "id bigint, orbit array<bigint>, split string, label string")
    large = small.withColumn("id", F.xxhash64("id"))
    found = [sorted(map(tuple, G.tolerance_sweep(df, [0, 2, 4]).collect())) for df in (small, large)]
    assert found[0] == found[1] and len(found[0]) == 3


def hamming(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def planted(n, seed, flips=6):
    """Random signed hashes, many of them a few bits away from an earlier one."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        if out and rng.random() < 0.6:
            h = rng.choice(out) & (2**64 - 1)
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                h ^= 1 << bit
        else:
            # Half of the fresh hashes share their upper bits: crowded buckets.
            h = rng.getrandbits(64) if rng.random() < 0.5 else rng.getrandbits(20)
        out.append(H.signed64(h))
    return out


def brute_groups(orbits, d):
    parent = {i: i for i in orbits}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(orbits)
    for i in ids:
        for j in ids:
            if i < j:
                same = sorted(orbits[i]) == sorted(orbits[j])
                near = d > 0 and min(hamming(a, b) for a in orbits[i] for b in orbits[j]) <= d
                if same or near:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def reachable(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_band_widths():
    widths = lambda n: [m.bit_count() for m in H.slice_mask(H.FULL_MASK, n)]
    assert widths(1) == [64]
    assert widths(3) == [22, 21, 21]
    assert widths(5) == [13, 13, 13, 13, 12]
    assert widths(7) == [10, 9, 9, 9, 9, 9, 9]


@given(st.integers(1, 12), st.lists(st.integers(0, 63), max_size=12, unique=True), st.integers(1, 10**12))
@settings(max_examples=60, deadline=None)
def test_search_plan_keeps_every_close_pair_together(d, flips, n):
    """However many hashes there are, d flips leave some slice within its radius."""
    x = sum(1 << b for b in flips[:d])
    plan, entries, _ = G.search_plan(n, d)
    assert any((p.mask & x).bit_count() <= p.radius for p in plan)
    assert sum(p.mask for p in plan) == H.FULL_MASK
    if d <= 12 and max(p.mask.bit_count() for p in plan) < 17:
        assert all(len(p.ball) == len(set(p.ball)) <= G.MAX_BALL for p in plan)


def test_entries_of_a_wide_search():
    """Entries written per hash at 12 bits: stated in search_plan."""
    assert [G.search_plan(n, 12)[1] for n in (10**4, 10**5, 10**6, 10**9)] == [35, 154, 556, 556]


def test_a_million_hashes_within_four_bits(spark):
    """Each planted pair comes out, once, and nothing else does."""
    rng = np.random.default_rng(8)
    hashes = rng.integers(-(2**63), 2**63 - 1, 1_000_000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(50)], np.uint64)
    hashes[-50:] = (hashes[:50].astype(np.uint64) ^ flips).astype(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"owner": np.arange(len(hashes)), "h": hashes}))
    got = sorted(map(tuple, G.near_pairs(df, 4).collect()))
    assert got == [(k, 999_950 + k, 4) for k in range(50)]


@pytest.mark.parametrize("n_blocks", [1, 3])
def test_pairs_of_blocks_are_all_pairs(spark, n_blocks):
    """Every near pair comes out once; a forest of them joins the same hashes up to any distance."""
    hashes = sorted(set(planted(700, 5)))
    df = spark.createDataFrame(list(enumerate(hashes)), "owner bigint, h bigint")
    want = {(a, b, d) for a in range(len(hashes)) for b in range(a) if (d := hamming(hashes[a], hashes[b])) <= 12}
    got = [tuple(r) for r in G._pairs_of_blocks(df, 12, n_blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == {(b, a, d) for a, b, d in want}
    forest = [tuple(r) for r in G._pairs_of_blocks(df, 12, n_blocks, forest=True).collect()]
    assert set(forest) <= set(got) and len(forest) < len(got) / 2
    for most in (0, 3, 8, 12):
        sides = [[(a, b) for a, b, d in rows if d <= most] for rows in (got, forest)]
        assert reachable(range(len(hashes)), sides[0]) == reachable(range(len(hashes)), sides[1])


def test_a_wide_search_writes_few_entries(spark):
    """Hashes within 12 bits are compared by blocks: the search shuffles each a few times, not 35 times and more."""
    df = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.col("id").alias("owner"))
    rows = G.near_pairs(df, 12)
    assert rows.count() == G._pairs_of_blocks(df, 12, 3).count()
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()


def test_grid_hash_and_orbit(spark):
    rng = np.random.default_rng(1)
    grids = [rng.integers(0, 9, (8, 8)).tolist() for _ in range(5)]
    flat = [(k, [float(x) for row in g for x in row]) for k, g in enumerate(grids)]
    df = spark.createDataFrame(flat, "id int, g array<double>")
    rows = {r["id"]: r["o"] for r in df.select("id", H.grid_orbit(F.col("g"), 8).alias("o")).collect()}

    def plain(m):
        bits = (m[:, 1:] > m[:, :-1]).ravel()
        return int("".join("1" if b else "0" for b in bits), 2)

    for k, g in enumerate(grids):
        m = np.array(g)
        want = []
        for turns in range(4):
            turned = np.rot90(m, turns)
            want += [plain(turned), plain(np.fliplr(turned))]
        assert rows[k] == want
    moved = [(k, np.rot90(np.array(g), k)[::-1].astype(float).ravel().tolist()) for k, g in enumerate(grids)]
    again = spark.createDataFrame(moved, "id int, g array<double>").select(
        "id", H.orbit_signature(H.grid_orbit(F.col("g"), 8)).alias("s")
    )
    assert {r["id"]: r["s"] for r in again.collect()} == {k: sorted(o) for k, o in rows.items()}


def test_first_bit_is_the_sign(spark):
    df = spark.createDataFrame([([0, 1] + [0] * 70,)], "g array<int>")
    h = df.select(H.grid_hash(F.col("g"), 8, 9).alias("h")).first()["h"]
    assert h == -(2**63)


@pytest.mark.parametrize("d,max_bucket,hot_rows", [(2, 2000, 10**6), (4, 8, 5), (12, 30, 50)])
def test_near_pairs_are_all_pairs(spark, d, max_bucket, hot_rows):
    hashes = sorted(set(planted(250, d)))
    df = spark.createDataFrame(list(enumerate(hashes)), "owner bigint, h bigint")
    got = G.near_pairs(df, d, max_bucket, hot_rows).distinct().collect()
    want = {
        (i, j, hamming(a, b))
        for i, a in enumerate(hashes)
        for j, b in enumerate(hashes)
        if i < j and hamming(a, b) <= d
    }
    assert {tuple(r) for r in got} == want
    assert want


@pytest.mark.parametrize("d,max_bucket,hot_rows", [(0, 6, 4), (2, 2000, 10**6), (4, 6, 4)])
def test_groups_match_brute_force(spark, d, max_bucket, hot_rows):
    """Orbits of three orientations, a third of all files one photo, some files unreadable."""
    rng = random.Random(d)
    base = planted(60, 7, flips=3)
    orbits = {k: [base[k], rng.choice(base), H.signed64(rng.getrandbits(64))] for k in range(60)}
    for k in range(60, 100):
        orbits[k] = orbits[5][::-1]
    rows = [(k, o) for k, o in orbits.items()] + [(k, None) for k in range(100, 105)]
    df = spark.createDataFrame(rows, "id bigint, orbit array<bigint>").repartition(7)
    got = {r["id"]: r["group_id"] for r in G.near_dup_groups(df, d, max_bucket, hot_rows).collect()}
    assert got == brute_groups(orbits, d)


@pytest.mark.parametrize("hot_rows", [3])
def test_components_on_hard_shapes(spark, hot_rows):
    rng = random.Random(3)
    chain = list(range(0, 400, 2))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:]))
    edges += [(1001, k) for k in range(1003, 1203, 2)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    nodes = sorted({x for e in edges for x in e} | {5000, 5001})
    want = reachable(nodes, edges)
    e = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    n = spark.createDataFrame([(x,) for x in nodes], "node bigint")
    got = {r["node"]: r["component"] for r in connected_components(n, e, hot_rows=hot_rows).collect()}
    assert got == want


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("most", [7, 10**6])
def test_contract_keeps_components(spark, weight, most):
    """Fewer edges join the same nodes, with a weight at every bound on it; batches and limits change nothing."""
    rng = random.Random(9)
    edges = [(a, b, rng.randrange(5)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a != b]
    df = spark.createDataFrame(edges, "u bigint, v bigint, w int").repartition(3)
    kept = list(map(tuple, contract(df, weight, most).collect()))
    assert len(kept) <= len(edges) and (not weight or set(kept) <= set(edges))
    assert weight or most < 10 or len(kept) <= 3 * 59
    for bound in range(5) if weight else [9]:
        within = lambda rows: [e[:2] for e in rows if len(e) < 3 or e[2] <= bound]
        assert reachable(range(60), within(kept)) == reachable(range(60), within(edges))
    assert contract(df.filter("false"), weight).collect() == []


def test_a_star_and_a_path_need_few_rounds(spark, monkeypatch):
    from sparkcurate.operators import components as CC

    rounds, real = [], CC._progress
    monkeypatch.setattr(CC, "_progress", lambda e: rounds.append(real(e)) or rounds[-1])
    ids = spark.range(20_000)
    for edges, most in ((ids.selectExpr("0L as a", "id + 1 as b"), 0), (ids.selectExpr("id as a", "id + 1 as b"), 3)):
        rounds.clear()
        nodes = spark.range(20_001).withColumnRenamed("id", "node")
        assert connected_components(nodes, edges).filter("component <> 0").count() == 0
        assert len(rounds) - 1 <= most


def test_stats_and_dense_ids(spark):
    rows = [(k, k // 3 * 3) for k in range(9)] + [(100, 100)]
    groups = spark.createDataFrame(rows, "id bigint, group_id bigint")
    stats = G.group_stats(groups).first().asDict()
    assert stats["n_groups"] == 4 and stats["n_redundant_images"] == 6 and stats["largest_group"] == 3
    assert stats["redundancy_pct"] == pytest.approx(60.0)
    dense = {r["id"]: r["dense_id"] for r in G.dense_group_ids(groups).collect()}
    assert dense == {**{k: k // 3 for k in range(9)}, 100: 3}
    empty = G.group_stats(groups.filter("false")).first().asDict()
    assert empty["n_images"] == 0 and empty["redundancy_pct"] == 0.0


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_attach_with_a_hot_key(spark, how):
    rows = [(k, "hot" if k % 3 else f"k{k % 7}") for k in range(300)] + [(999, "nowhere")]
    big = spark.createDataFrame(rows, "id bigint, key string").repartition(6)
    keyed = big.filter("key <> 'nowhere' and key <> 'k1'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    plain = big.join(keyed.drop("n"), "key", how)
    salted = attach(big, keyed, "key", "id", "n", how, hot_rows=20)
    columns = sorted(plain.columns)
    assert sorted(map(str, salted.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
    assert sorted(salted.columns) == columns


def test_as_many_buckets_as_asked(spark):
    """More buckets than one list of cuts may have: cut in two levels, even to a tenth, order kept."""
    n, asked = 1_000_000, 20_000
    df = spark.range(n).select(F.xxhash64("id").cast("double").alias("x"), F.lit(1).alias("one"))
    cut = into_buckets(df, "x", asked)
    sizes = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
    assert abs(len(sizes) - asked) <= 0.1 * asked and sizes.n.sum() == n and sizes.n.max() <= 4 * n / asked
    sizes = sizes.sort_values("_bucket")
    assert (sizes.high.to_numpy()[:-1] < sizes.low.to_numpy()[1:]).all()


def test_ties_are_parted_by_the_next_column(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST_CUTS", 7)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") % 90).alias("x"), F.lit("g").alias("g"))
    cut = into_buckets(df, ["x", "id"], 40)
    assert cut.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 4 * 3000 / 40
    got = prefix_scan(cut, ["g"], ["x", "id"], {"n": ("count", F.lit(1))}).collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.x, r.id))] == list(range(3000))
    assert into_buckets(df.filter("false"), ["x", "id"], 40).count() == 0


def test_hash_rank_and_prefix_scan(spark):
    rng = random.Random(5)
    rows = [(k, "hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, g string, v bigint").withColumn("h", F.md5(F.col("id").cast("string")))
    ranked = hash_rank(df, ["g"], "h", "id", "rank", "total", hex_digits=2).collect()
    by = {}
    for r in ranked:
        by.setdefault(r["g"], []).append(r)
    for group in by.values():
        group.sort(key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in group] == list(range(1, len(group) + 1))
        assert {r["total"] for r in group} == {len(group)}
    aggs = {
        "s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")),
    }
    got = {r["id"]: (r["s"], r["n"], r["hi"], r["lo"]) for r in prefix_scan(df, ["g"], ["id"], aggs, 9).collect()}
    for k, g, _ in rows:
        before = [v for j, h, v in rows if h == g and j < k]
        assert got[k] == (sum(before), len(before), max(before, default=None), min(before, default=None))


def near_labels(h, label, left, right, d):
    edges = [(label[i], label[j]) for i in left for j in right if hamming(int(h[i]), int(h[j])) <= d]
    found = reachable(range(max(label) + 1), edges)
    return [found[k] for k in range(max(label) + 1)]


@pytest.mark.parametrize("costs", [(0, 0), (3, 5), (10**9, 10**9)])
@pytest.mark.parametrize("d,same", [(1, True), (2, False), (5, True), (8, False), (12, False), (12, True)])
def test_linked_labels_hang_together(monkeypatch, d, same, costs):
    """By slices or by tiles, with labels that most hashes share or none: what all pairs join is joined."""
    monkeypatch.setattr(G, "LOOK_UP", costs[0])
    monkeypatch.setattr(G, "COMPARE", costs[1])
    monkeypatch.setattr(G, "AT_ONCE", 2_000)
    for seed in range(3):
        h = np.array(sorted(set(planted(160, seed))), np.int64).view(np.uint64)
        rng = np.random.default_rng(seed)
        label = np.unique(np.minimum(rng.permutation(len(h)), [999, 90, 20][seed]), return_inverse=True)[1].astype(np.int32)
        side = rng.random(len(h)) < 0.5
        left = np.arange(len(h)) if same else np.flatnonzero(side)
        right = left if same else np.flatnonzero(~side)
        got = G._linked(h, label, left, right, same, d)
        assert got.tolist() == near_labels(h, label.tolist(), left, right, d)


@pytest.mark.parametrize("local_links", [0, 10**6])
def test_sweep_group_by_group(spark, monkeypatch, local_links):
    """Groups carried from tolerance to tolerance are those of one search; a third of the files is one picture."""
    base = planted(300, 11)
    rng = random.Random(1)
    rows = [(i, [h, rng.choice(base)] if i % 4 == 0 else [h]) for i, h in enumerate(base + [base[7]] * 150)]
    rows = [(i, o, rng.choice(["train", "val", "test"]), rng.choice("ab")) for i, o in rows] + [(999, None, "test", "a")]
    df = spark.createDataFrame(rows, "id bigint, orbit array<bigint>, split string, label string")
    distances = [0, 2, 5, 8, 12]
    want = sorted(map(tuple, G.tolerance_sweep(df, distances).collect()))
    calls, real = [], G._links_of_blocks
    monkeypatch.setattr(G, "_links_of_blocks", lambda *a: calls.append(a[1:]) or real(*a))
    for name, value in {"SOME_HASHES": 100, "LOCAL_LINKS": local_links, "MANY_HASHES": 100, "MANY_ENTRIES": 3, "FEWER": 1}.items():
        monkeypatch.setattr(G, name, value)
    assert sorted(map(tuple, G.tolerance_sweep(df, distances).collect())) == want
    assert [d for d, _ in calls] == [2, 5, 8, 12] and calls[0][1] > 1


def test_many_hashes_need_few_comparisons(monkeypatch):
    """Of 60,000 hashes around a few hundred far more than nine tenths of the pairs are never compared."""
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)[rng.integers(0, 300, 60_000)]
    for _ in range(6):
        h = h ^ (np.uint64(1) << rng.integers(0, 64, len(h), dtype=np.uint64))
    compared, real = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(x.size) or real(x))
    h = np.unique(h)
    label, half = np.arange(len(h), dtype=np.int32), np.arange(len(h)) < len(h) // 2
    for d in (2, 4, 6, 8, 10, 12):
        piece = G._linked(h, label, np.flatnonzero(half), np.flatnonzero(~half), False, d)
        label = np.unique(piece[label], return_inverse=True)[1].astype(np.int32)
    assert sum(compared) < 0.1 * (len(h) / 2) ** 2
