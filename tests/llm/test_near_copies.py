"""Near copies against all pairs, and the stage on copies that the fingerprints of two bits lose."""

import random

import numpy as np
import pytest
from llm_cases import SCHEMA, edge_texts, lower, rows, words

import corpus_pipeline
from eventloom.llm import near_copies as module
from eventloom.llm.common import ship
from eventloom.llm.near_copies import bit_map, near_copies


def shingles_of(text: str | None, n: int = 5) -> set:
    all_words = words(lower(text or ""))
    return {tuple(all_words[i:i + n]) for i in range(max(1, len(all_words) - n + 1))}


def components(texts: list[str | None], least: float = 0.8) -> list[int]:
    """First index of every text's component, over all pairs."""
    sets, root = [shingles_of(t) for t in texts], list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def changed_copies() -> list[str]:
    """Texts with copies around the threshold, a chain of copies, and a passage that many share."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out, passage = [], some(40)
    for n, changes in [(100, 1), (100, 2), (100, 3), (100, 4), (300, 1), (300, 3), (300, 8), (1000, 10), (1000, 25)] * 4:
        base = some(n)
        copy = list(base)
        for at in rng.sample(range(n), changes):
            copy[at] = "changed"
        out += [" ".join(base), " ".join(copy)]
    chain = some(200)
    for i in range(12):
        chain = chain[5:] + some(5)
        out.append(" ".join(chain))
    out += [" ".join(passage + some(rng.randint(5, 60))) for _ in range(80)]
    return out


def test_shingle_set_against_brute_force():
    for text in [None, "", "a b", "A b C d e f", *changed_copies()[:4]]:
        assert len(module.shingle_set((text or "").encode(), 5)) == len(shingles_of(text))


@pytest.mark.parametrize("sampled", [1 << 13, 16])
def test_against_all_pairs(spark, monkeypatch, sampled):
    monkeypatch.setattr(module, "_SAMPLED", sampled)
    ship(spark)
    texts = changed_copies() + [t for _, t, _ in edge_texts()]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in near_copies(table).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_stage_finds_copies_with_few_changed_words(spark):
    texts = changed_copies()
    docs = spark.createDataFrame(rows([(i, t, "a") for i, t in enumerate(texts)]), SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect())
    assert kept == sorted(set(components(texts))) and len(kept) < len(texts) - 20


def test_stage_judges_each_text_of_a_repeated_id(spark):
    texts = changed_copies()[:2]
    docs = spark.createDataFrame(rows([(1, texts[0], "a"), (2, texts[1], "a"), (2, "quite another text", "a")]), SCHEMA)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()) == [
        (1, texts[0]), (2, "quite another text")]


def test_large_group_gives_few_pairs(spark, monkeypatch):
    """Copies of one text that are near some of the others only: found over few pairs, and all of them."""
    rng, formed = random.Random(5), []
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(120), 1 if i % 10 else 2):
            copy[at] = f"c{i}x{at}"
        texts.append(" ".join(copy))
    kept = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: (formed.append((name, out := kept(df, name))), out)[1])
    ship(spark)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in near_copies(table).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)
    pairs = [df.count() for name, df in formed if name == "near-pairs"]
    assert sum(pairs) < 300 * 299 / 2 / 2


def test_maps_of_sets_of_any_size():
    """Maps differ in no more bits than their sets in shingles, also where one is folded to the other's size."""
    rng = np.random.default_rng(4)
    for n in (1, 900, 1024, 1025, 3000, 20_000):
        base = np.unique(rng.integers(-2**63, 2**63 - 1, n))
        for changed in (0, 1, n // 10):
            other = np.unique(np.concatenate((base[changed:], rng.integers(-2**63, 2**63 - 1, changed // 2))))
            a, b = bit_map(base), bit_map(other)
            if len(a) > len(b):
                a = a[:len(b)] ^ a[len(b):]
            if len(b) > len(a):
                b = b[:len(a)] ^ b[len(a):]
            apart = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(base, other))
        strange = bit_map(np.unique(rng.integers(-2**63, 2**63 - 1, n)))
        if len(strange) == len(bit_map(base)) and n > 900:
            assert int(np.bitwise_count((strange ^ bit_map(base)).view(np.uint64)).sum()) > 2 * n / 9


def test_fingerprints_and_unlike_lists_give_the_pairs(spark, monkeypatch):
    """Copies that the index over byte positions links are in the first round, and a passage of 40 words that
    20 texts share is one list, not one for each of its shingles; all links are found."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} x{i}" for i in range(20)] + [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(10)]
    texts += [t.upper() + " more" for t in texts[20:]]
    kept, formed = module.stored, []
    monkeypatch.setattr(module, "stored", lambda df, name: (formed.append((name, out := kept(df, name))), out)[1])
    ship(spark)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in near_copies(table).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)
    made = dict(reversed(formed))
    nodes = {r.node: r.fp for r in made["near-nodes"].collect()}
    alike = {frozenset((r.a, r.b)) for r in made["near-alike"].collect()}
    near = {frozenset((a, b)) for a in nodes for b in nodes if a < b and ((nodes[a] ^ nodes[b]) & (2**64 - 1)).bit_count() <= 2}
    roots, expected = {x: x for x in nodes}, {x: x for x in nodes}
    for pairs, of in ((alike, roots), (near, expected)):
        for _ in nodes:
            for a, b in map(sorted, pairs):
                of[a] = of[b] = min(of[a], of[b])
    assert near and roots == expected
    first = {frozenset((r.a, r.b)) for r in made["near-pairs"].collect()}
    assert alike <= first
    lists = {}
    for r in made["near-lists"].collect():
        lists.setdefault(r.shingle, set()).add(r.x.node)
    assert len({frozenset(of) for of in lists.values()}) == len(lists)


def families() -> list[str]:
    """Copies of a few texts with so many changed words that most are like few others of their family."""
    rng, out = random.Random(11), []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(150)]
        for i in range(120):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(1, 7)):
                copy[at] = f"f{f}c{i}x{at}"
            out.append(" ".join(copy[:rng.choice([150, 150, 140, 130])]))
    return out


@pytest.mark.parametrize("sampled", [1 << 13, 16])
def test_families_of_copies_give_few_pairs(spark, monkeypatch, sampled):
    """Joins of the second round make rows near the number of texts, not of pairs in a family; no link is lost."""
    texts = families()
    kept, formed = module.stored, []
    monkeypatch.setattr(module, "_SAMPLED", sampled)
    monkeypatch.setattr(module, "stored", lambda df, name: (formed.append((name, out := kept(df, name))), out)[1])
    ship(spark)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in near_copies(table).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)
    pairs = [df.count() for name, df in formed if name == "near-pairs"]
    assert sum(pairs) < 8 * len(texts) and pairs[-1] < len(texts)


def test_similar_sets_meet_in_the_lists_that_stay(spark):
    """Of lists with the same nodes the first is kept: every similar pair has one where all it shares is still to come."""
    rng, sets = random.Random(2), []
    for _ in range(60):
        base = rng.sample(range(100), rng.randint(5, 40))
        sets += [sorted(base), sorted(set(base[rng.randint(0, 4):]) | {rng.randint(0, 100) for _ in range(rng.randint(0, 4))})]
    index = [(i, len(s), at, token) for i, s in enumerate(sets) for at, token in enumerate(s[:len(s) - -(-4 * len(s) // 5) + 1])]
    entries = spark.createDataFrame(index, "node long, n long, at int, shingle long")
    lists = {r.shingle for r in module._unlike_lists(entries, module.Fraction(4, 5)).collect()}
    place = {(i, token): at for i, _, at, token in index}
    similar = [(a, b) for a in range(len(sets)) for b in range(a)
               if len({*sets[a]} & {*sets[b]}) * 5 >= len({*sets[a]} | {*sets[b]}) * 4]
    assert len(similar) > 20 and len(lists) < len({token for *_, token in index})
    for a, b in similar:
        least = (len(sets[a]) + len(sets[b])) * 4 / 9
        assert any((a, t) in place and (b, t) in place and min(len(sets[i]) - place[i, t] for i in (a, b)) >= least - 1e-9
                   for t in lists)
