"""Line, substring, exact and near duplicates against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_cases import SCHEMA, SPACES, edge_texts, lower, rows, words

from eventloom.llm import simhash
from eventloom.llm.common import ship
from eventloom.llm.components import connected_components
from eventloom.llm.exact_dedup import exact_dedup
from eventloom.llm.line_dedup import line_dedup
from eventloom.llm.substring_dedup import COVER, PERIOD, substring_dedup


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(rows(edge_texts()), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_no_rows(nothing):
    for op in (line_dedup, substring_dedup, exact_dedup, simhash.near_duplicates):
        assert op(nothing).collect() == []


def line_brute(texts, min_docs=5, min_length=40):
    key = lambda line: lower(line.strip(SPACES))
    holders = defaultdict(set)
    for i, text, _ in texts:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_length:
                holders[key(line)].add(i)
    low = lambda i: (i is not None, i or 0)
    keeper = {k: max(ids, key=low) for k, ids in holders.items() if len(ids) >= min_docs}
    out = Counter()
    for i, text, _ in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines(docs):
    brute = line_brute(edge_texts())
    assert sum(n for (_, _, dropped, _), n in brute.items() if dropped) > 20
    assert found(line_dedup(docs), "id", "n_lines", "n_dropped", "kept") == brute
    assert found(line_dedup(docs, min_docs=2, min_length=1), "id", "n_lines", "n_dropped", "kept") == line_brute(edge_texts(), 2, 1)


def window_brute(texts, window=35):
    places = defaultdict(list)
    split = [words(t) for _, t, _ in texts]
    for d, ws in enumerate(split):
        for at in range(len(ws) - window + 1):
            places[tuple(ws[at:at + window])].append((d, at))
    gone = [set() for _ in texts]
    for spots in places.values():
        if len(spots) > 1:
            for d, at in spots:
                gone[d].update(range(at, at + window))
    return Counter((i, len(ws), len(g), " ".join(w for n, w in enumerate(ws) if n not in g))
                   for (i, _, _), ws, g in zip(texts, split, gone))


def test_cover_reaches_every_pair():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER for s in range(PERIOD))


@pytest.mark.parametrize("group_bytes", [2 << 20, 300])
def test_substrings(docs, group_bytes):
    brute = window_brute(edge_texts())
    assert sum(1 for _, _, removed, _ in brute if removed) > 5
    assert found(substring_dedup(docs, group_bytes=group_bytes), "id", "n_words", "n_removed", "kept") == brute


def test_substrings_within_one_text_and_at_edges(spark):
    unit = " ".join(f"w{i}" for i in range(35))
    texts = [(1, f"{unit} {unit}", "a"), (2, f"x {unit[:-1]}", "a"), (3, "a " * 200, "a"),
             (4, " ".join(f"w{i}" for i in range(34)), "a"), (5, f"{unit} tail", "a")]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert found(substring_dedup(df), "id", "n_words", "n_removed", "kept") == window_brute(texts)


def test_exact(docs):
    texts = edge_texts()
    groups = defaultdict(list)
    for i, text, _ in texts:
        groups[lower(text or "")].append(i)
    for salts in (256, 1):
        got = exact_dedup(docs, salts=salts).collect()
        assert len(got) == len(texts)
        by_text = defaultdict(list)
        for r in got:
            by_text[r.text_sha256].append(r)
        assert len(by_text) == len(groups)
        for text, ids in groups.items():
            mine = by_text[hashlib.sha256(text.encode()).hexdigest()]
            keep = max((i for i in ids if i is not None), default=None)
            assert Counter(r.id for r in mine) == Counter(ids)
            assert {(r.keep_id, r.group_size) for r in mine} == {(keep, len(ids))}
            assert [r.id for r in mine if r.kept] == [keep]


def print_brute(text):
    ws = lower(text or "").encode().split()
    shingles = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_brute(prints):
    prints, roots = list(prints), {}
    for start in prints:
        if start not in roots:
            roots[start], edge = start, [start]
            while edge:
                a = edge.pop()
                for b in prints:
                    if b not in roots and (a ^ b).bit_count() <= 2:
                        roots[b] = start
                        edge.append(b)
    return roots


def test_near_duplicates(docs):
    texts = edge_texts()
    prints = [print_brute(t) for _, t, _ in texts]
    roots = component_brute(sorted(set(prints)))
    least = {}
    for (i, _, _), p in zip(texts, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    expected = Counter((i, signed(p), least.get(roots[p])) for (i, _, _), p in zip(texts, prints))
    assert found(simhash.near_duplicates(docs), "id", "fp", "component_id") == expected


def test_meeting_in_a_list_is_reaching_the_least_tally():
    """Two fingerprints share a key of some choice of six byte positions exactly where the tally of equal
    positional bytes is six or more; fingerprints within two bits always reach it."""
    rng = np.random.default_rng(9)
    near = 0
    for _ in range(3000):
        a = rng.integers(0, 256, 8)
        b = a.copy()
        for _ in range(rng.integers(0, 4)):
            b[rng.integers(0, 8)] ^= 1 << rng.integers(0, 8)
        if rng.random() < 0.2:
            b = rng.integers(0, 4, 8) + a * (rng.random(8) < 0.7)
        tally = int((a == b).sum())
        meets = any(all(a[i] == b[i] for i in range(8) if i not in pair) for pair in simhash.OPEN_BYTES)
        assert meets == (tally >= 6)
        bits = sum(int(x ^ y).bit_count() for x, y in zip(a.tolist(), b.tolist()))
        near += bits <= 2
        assert bits > 2 or meets
    assert near > 500


def test_links_of_fingerprints_in_a_hot_list(spark):
    """Thousands of fingerprints that differ in two bytes only, beside others at one to three bits."""
    ship(spark)
    rng = np.random.default_rng(5)
    base = 0x1234567890ABCDEF
    prints = {base ^ int(x) for x in rng.choice(1 << 16, 900, replace=False)}
    for _ in range(300):
        p = int(rng.integers(0, 1 << 63)) << 1
        prints |= {p, p ^ (1 << int(rng.integers(64))), p ^ (7 << int(rng.integers(60)))}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    got = {r.node: r.root for r in connected_components(links).collect()}
    roots = component_brute(sorted(prints))
    sets = defaultdict(set)
    for p in prints:
        sets[roots[p]].add(signed(p))
    mine = defaultdict(set)
    for p in prints:
        mine[got.get(signed(p), signed(p))].add(signed(p))
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1001 + i) for i in range(500)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (3, 4)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(501)}}
