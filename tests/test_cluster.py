"""The five methods: worked cases, and the two physical paths against each other and brute force."""

import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlens.operators.cluster import METHODS, UMIClusterer, cluster, group_bundle

WORKED = {"ACGT": 456, "TCGT": 2, "CCGT": 2, "ACAT": 72, "ACAG": 90, "AAAT": 1}


def differ(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def brute(counts, method, threshold):
    """Groups by plain definitions: closure of reachability, and covers tried one by one."""
    order = sorted(counts, key=lambda u: (-counts[u], u))
    if method == "unique":
        return {frozenset([u]) for u in counts}
    if method == "percentile":
        values = sorted(counts.values())
        mid = len(values) // 2
        median = values[mid] if len(values) % 2 else (values[mid - 1] + values[mid]) / 2
        return {frozenset([u]) for u in counts if len(counts) == 1 or counts[u] > median / 100}
    edge = {(a, b) for a in counts for b in counts if a != b and differ(a, b) <= threshold}
    if method == "directional":
        edge = {(a, b) for a, b in edge if counts[a] >= 2 * counts[b] - 1}
    reach = {u: {u} for u in counts}
    for _ in counts:
        for a, b in edge:
            reach[a] |= reach[b]
    left, groups = set(counts), []
    for u in order:
        if u in left:
            groups.append(reach[u] & left)
            left -= reach[u]
    if method != "adjacency":
        return {frozenset(g) for g in groups}
    out = set()
    for component in groups:
        ranked = [u for u in order if u in component]
        near = {u: {v for v in component if (u, v) in edge} | {u} for u in component}
        k = next(k for k in range(1, len(ranked) + 1) if set().union(*(near[u] for u in ranked[:k])) == component)
        leads = ranked[:k]
        owner = {u: u for u in leads}
        for u in component - set(leads):
            owner[u] = next(v for v in leads if u in near[v])
        out |= {frozenset(u for u in component if owner[u] == lead) for lead in leads}
    return out


def grouped(counts, method, threshold):
    return {frozenset(g) for g in UMIClusterer(method)(counts, threshold)}


def test_worked_example():
    sizes = {m: len(UMIClusterer(m)(WORKED, 1)) for m in METHODS}
    assert sizes == {"unique": 6, "percentile": 6, "cluster": 1, "adjacency": 3, "directional": 2}
    assert UMIClusterer("directional")({k.encode(): v for k, v in WORKED.items()}, threshold=1)[0][0] == b"ACGT"


@pytest.mark.parametrize("method", METHODS)
@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("ACG", min_size=4, max_size=4), st.integers(1, 12), min_size=1, max_size=16), st.integers(0, 2))
def test_against_brute_force(method, counts, threshold):
    assert grouped(counts, method, threshold) == brute(counts, method, threshold)


def test_large_bundles_use_the_slice_index():
    rng = random.Random(3)
    counts = {"".join(rng.choice("ACGT") for _ in range(8)): rng.randint(1, 50) for _ in range(120)}
    counts |= {"".join(rng.choice("ACGT") if rng.random() < 0.1 else c for c in u): 2 for u in list(counts)}
    for threshold in (1, 2, 3):
        for method in ("cluster", "directional", "adjacency"):
            assert grouped(counts, method, threshold) == brute(counts, method, threshold)


def test_bad_input():
    with pytest.raises(ValueError):
        UMIClusterer("nearest")
    with pytest.raises(ValueError):
        group_bundle(["AA", "AAA"], [1, 1], "cluster", 1)


@pytest.mark.parametrize("method", METHODS)
def test_paths_agree(spark, method):
    rng = random.Random(5)
    rows = [(f"b{i % 7}", None if i % 3 else "x", "".join(rng.choice("ACGT") for _ in range(4)), rng.randint(1, 30)) for i in range(600)]
    seen = {}
    for b, c, u, n in rows:
        seen[b, c, u] = n
    df = spark.createDataFrame([(*k, n) for k, n in seen.items()], "b string, c string, umi string, n long")
    plain = df.groupBy("b", "umi").agg(F.sum("n").alias("n"))
    left = {tuple(r) for r in cluster(plain, ["b"], method, 1, path="grouped").collect()}
    right = {tuple(r) for r in cluster(plain, ["b"], method, 1, path="relational").collect()}
    mixed = {tuple(r) for r in cluster(plain, ["b"], method, 1, hot_bundle=60).collect()}
    assert left == right == mixed and left


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "AAAA", 5), (None, "AAAT", 1), ("k", "AAAT", 1)], "k string, umi string, n long")
    got = {tuple(r) for r in cluster(df, ["k"]).collect()}
    assert got == {(None, "AAAA", 5, "AAAA"), (None, "AAAT", 1, "AAAA"), ("k", "AAAT", 1, "AAAT")}
    assert cluster(df.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("method", METHODS)
def test_paths_agree_on_odd_tables(spark, method):
    """Null keys, one barcode alone, equal counts: the same from both paths."""
    rows = [(None, "AAAA", 5), (None, "AAAT", 1), (None, "AATT", 1), (None, "GGGG", 900), ("k", "AAAT", 1), ("m", "ACGT", 3), ("m", "ACGA", 3), ("m", "TTTT", 1)]
    df = spark.createDataFrame(rows, "k string, umi string, n long")
    grouped_, relational, mixed = ({tuple(r) for r in cluster(df, ["k"], method, path=path, hot_bundle=hot).collect()} for path, hot in (("grouped", 9), ("relational", 9), ("auto", 2)))
    assert grouped_ == relational == mixed and len(grouped_) >= 6 and any(r[0] is None for r in grouped_)


@pytest.mark.parametrize("path", ["grouped", "relational", "auto"])
@pytest.mark.parametrize("method", ["cluster", "directional", "adjacency"])
def test_mixed_lengths_raise_on_every_path(spark, method, path):
    df = spark.createDataFrame([("k", "AAAA", 5), ("k", "AAA", 1), ("l", "C", 1)], "k string, umi string, n long")
    with pytest.raises(Exception, match="same length"):
        cluster(df, ["k"], method, path=path, hot_bundle=1).collect()
    fine = df.where("umi <> 'AAA'")
    assert cluster(fine, ["k"], method, path=path).count() == 2


def test_pairs_join_is_exact(spark):
    from strandlens.functions.distance import near_pairs

    rng = random.Random(8)
    umis = sorted({"".join(rng.choice("ACGT") for _ in range(6)) for _ in range(150)})
    df = spark.createDataFrame([("k", u) for u in umis], "k string, umi string")
    for t in (0, 1, 2, 3):
        got = sorted((r.a, r.b, r.distance) for r in near_pairs(df, ["k"], "umi", t).collect())
        assert got == sorted((a, b, differ(a, b)) for a, b in combinations(umis, 2) if differ(a, b) <= t)
