"""Top-k search and mixing against brute force and their invariants."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import SCHEMA, edge_texts, rows, words

import corpus_pipeline
from eventloom.llm.common import ship
from eventloom.llm.mixing import mix_sources, pivotal_rounding
from eventloom.llm.topk_search import (
    _searched, build_tree, part_of, quantised, search_tree, top_k, upper_splits)


def floor(x):
    return [int(np.floor(np.float64(v) * 1024)) for v in x]


def brute(vectors, k):
    whole = [(i, floor(v)) for i, v in vectors
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i % 100 == 0:
            scores = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in whole if j != i and len(v) == len(q)]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k_edges(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(300)]                       # one very common vector
    vectors += [(2000, None), (2100, [1.0, None] * 4), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8),
                (None, [0.1] * 8), (2400, []), (2500, []), (2600, [1.0, 2.0]), (2601, [3.0, 4.0]), (2700, [0.0] * 8),
                (2800, [3e30] * 8), (2801, [-3e30] * 8), (2900, [0.5] * 8), (2900, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in vectors], "vec_id long, embedding array<float>, rank int, score double")
    expected = brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in vectors], 10)
    for shard_rows, leaf, block in ((16384, 256, 2048), (200, 4, 2)):
        got = top_k(df, shard_rows=shard_rows, leaf=leaf, block_rows=block).collect()
        assert sorted(tuple(r) for r in got) == expected
    assert top_k(df.where("false")).collect() == []
    assert top_k(df.where("vec_id in (100, 101, 102)")).count() == 2      # fewer than k


def test_more_empty_vectors_than_a_leaf_holds(spark):
    ship(spark)
    vectors = [(i, [] if i % 3 else [float(i % 7), 1.0]) for i in range(900)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df).collect()) == brute(vectors, 10)      # 600 empty ones, leaf 256


def test_parts_of_the_upper_splits():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4000, 5))
    splits = upper_splits(points, 16)
    parts = part_of(splits, points)
    assert sorted(Counter(parts.tolist())) == list(range(16)) and max(Counter(parts.tolist()).values()) < 400
    same = upper_splits(np.ones((50, 5)), 4)
    assert set(part_of(same, np.ones((3, 5)))) == {0} and set(part_of(same, np.zeros((3, 5)))) == {0}


def test_queries_go_to_few_shards(spark):
    """Clustered vectors in many shards: what is sent does not grow with shards x blocks, results are whole."""
    ship(spark)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6))
    vectors = [(i, (centres[i % 40] * 3 + rng.normal(size=6) * 0.02).tolist()) for i in range(6000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    sent, queries = {}, sum(i % 25 == 0 for i, _ in vectors)
    for shard_rows in (300, 75):
        found, reached = _searched(quantised(df, "vec_id", "embedding", 1024), 3, 25, shard_rows, 16, 4)
        rows_ = reached.collect()
        shards, blocks = len({r.shard for r in rows_}), len({r.block for r in rows_})
        sent[shard_rows] = sum(len(r.places) // 4 for r in rows_)
        assert sent[shard_rows] < 0.4 * shards * queries and len(rows_) < 0.5 * shards * blocks
        got = sorted((r.query_id, -r.score, r.vec_id) for r in found.collect())
        best = {q: [x[1:] for x in got if x[0] == q][:3] for q in {x[0] for x in got}}
        whole = np.floor(np.array([v for _, v in vectors]) * 1024)
        for q in range(0, 6000, 25):
            scores = whole @ whole[q]
            order = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:3]
            assert best[q] == order
    assert sent[75] < 4 * sent[300]


def test_search_looks_into_few_leaves():
    """Where near vectors share a leaf, bounds leave most of the tree alone."""
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(64, 1, 3)) * 4000 + rng.normal(size=(64, 64, 3))).reshape(-1, 3)
    tree = build_tree(np.arange(len(points)), points, 64)
    query = points[:1]
    all_found = sorted(search_tree(tree, np.array([-1]), query, 5, [None]))
    floor_ = min(s for _, _, s in all_found)
    few = sorted(search_tree(tree, np.array([-1]), query, 5, [floor_], leaves=8))
    assert few == all_found


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(edge_texts()), SCHEMA)


def targets_brute(sizes, share=1.5, most=2.0):
    """As the words have it: cap, and deal the excess again by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mixing(spark, docs):
    texts = edge_texts()
    sizes = defaultdict(int)
    for _, t, s in texts:
        sizes[s] += len(words(t))
    got = mix_sources(docs).collect()
    assert sorted((str(r.id), r.size) for r in got) == sorted((str(i), len(words(t))) for i, t, _ in texts)
    targets, taken, largest = targets_brute(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.copies in ((int(ratio + 1e-9), int(np.ceil(ratio - 1e-9))) if r.size else (0,))
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, total in taken.items():
        assert abs(total - targets[s]) <= largest[s]
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(docs.where("false")).collect() == []


def test_stage_takes_rows_of_repeated_and_null_ids_by_their_own_draw(spark):
    texts = [(None if i % 2 else i % 5, " ".join(["w"] * (1 + i)), "ab"[i % 3 > 0]) for i in range(120)]
    table = spark.createDataFrame(rows(texts), SCHEMA)
    drawn = {(r.id, r.source, r.size): r.copies for r in mix_sources(table).collect()}
    assert Counter(copies for copies in drawn.values()).keys() <= {0, 1, 2}
    got = Counter((r.doc_id, r.source, len(words(r.text))) for r in corpus_pipeline.mix(spark, table, "").collect())
    assert len(drawn) == len(texts) and got == Counter({k: n for k, n in drawn.items() if n})


def test_many_equal_rows_take_their_share(spark):
    """Five hundred rows without an id, of one size and source, beside 4,000 others in 40 sources."""
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 40}") for i in range(4000)]
    texts += [(None, " ".join(["w"] * 50), "s1")] * 500
    table = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    got = mix_sources(table).collect()
    assert len(got) == len(texts)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert len({r.copies for r in got if r.id is None}) == 2        # some of the equal rows, not all or none
    stage = Counter((r.doc_id, r.source, len(words(r.text))) for r in corpus_pipeline.mix(spark, table, "").collect())
    assert stage == Counter({k: n for k, n in sum((Counter({(r.id, r.source, r.size): r.copies}) for r in got), Counter()).items() if n})


def test_rounding_keeps_mass_and_odds(spark):
    rng = np.random.default_rng(4)
    items = [("s", str(i), float(m), 0.3) for i, m in enumerate(rng.integers(1, 50, 700))]
    items += [(None, "0", 5.0, 0.0), (None, "1", 5.0, 1.0)]
    df = spark.createDataFrame(items, "source string, key string, mass double, part double")
    mass, ups = {k: m for s, k, m, _ in items if s}, 0
    for seed in range(3):
        got = pivotal_rounding(df, seed=seed, fan=16).collect()
        assert len(got) == len(items) and {(r.key, r.copy) for r in got if r.source is None} == {("0", 0), ("1", 1)}
        total = sum(mass[r.key] * r.copy for r in got if r.source)
        assert abs(total - 0.3 * sum(mass.values())) <= 50
        ups += sum(r.copy for r in got if r.source)
    assert abs(ups / 2100 - 0.3) < 0.05
