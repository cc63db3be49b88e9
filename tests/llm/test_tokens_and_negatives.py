"""Alignment, packing and hard negatives against brute force over whole texts and all rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest import DATA
from llm_cases import EXTRA, SCHEMA, edge_texts, rows
from tokenizers import Tokenizer

from eventloom.llm import packing, token_alignment
from eventloom.llm.catalog import BYTE_TOKENIZER, LLM_QUERIES, PIECE_MODEL, WORD_TOKENIZER
from eventloom.llm.hard_negatives import bit_planes, hard_negatives, scores, subset_sums
from eventloom.llm.packing import Cuts, concatenate, pieces, sequences
from eventloom.llm.token_alignment import Pieces, align, closed, containers, cut, opened, popcount

ODD = [" ", "  ", " a", "a ", "a  b", "a \nb", "a\n b", "\n", "a\xa0b c", "a b  c", "x<|endoftext|>y <|endoftext|> z",
       "a▁b c", "a▁ b", "it's we'll they 're", "<0x41> <s> </s> <unk>", "日本語 テスト 漢字", "é ́x", "😀😀 😀", "a\x00b \x00",
       "tab\t here", "1234567 89 0", "...!!! ?? -- ,", "<|startoftext|> A <|startoftext|>b", "ΑΣ ΣΑΣ. ΟΔΟΣ", "İstanbul ǅ"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    texts = edge_texts() + [(300 + i, t, "odd") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3).cache()


def aligned_brute(texts):
    """Per text: ids of both, groups, links; None where a tokenizer does not give the text back."""
    a = Tokenizer.from_file(BYTE_TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in own}
    for n, x in enumerate(x for x in range(256) if x not in own):
        chars[chr(256 + n)] = x
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        spelled_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                     for i, p in zip(ids_b, b.id_to_piece(ids_b))]
        whole = (" " + text).encode()
        if b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([*map(len, spelled_a)]), np.cumsum([*map(len, spelled_b)])
        both, lo_a, lo_b, groups, links = sorted({*ends_a.tolist()} & {*ends_b.tolist()}), 0, 0, [], Counter()
        for end in both:
            hi_a, hi_b = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((ids_a[lo_a:hi_a], ids_b[lo_b:hi_b]))
            for i in range(lo_a, hi_a):
                for j in range(lo_b, hi_b):
                    if ends_a[i] - len(spelled_a[i]) < ends_b[j] and ends_b[j] - len(spelled_b[j]) < ends_a[i]:
                        links[ids_a[i], ids_b[j]] += 1
            lo_a, lo_b = hi_a, hi_b
        out.append((ids_a, ids_b, groups, links))
    return out


def digests_brute(texts):
    found, counts, docs = aligned_brute(texts), Counter(), Counter()
    for f in found:
        counts.update(f[3] if f else {})
        docs.update((f[3] if f else {}).keys())
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in f[2])
        out.append((len(f[0]), len(f[1]), len(f[2]), sum(f[3].values()),
                    sum(n for p, n in f[3].items() if counts[p] == best[p[1]]), sum(n * counts[p] for p, n in f[3].items()),
                    hashlib.sha256(groups.encode()).hexdigest()))
    return out, counts, docs, best


def test_alignment_edges(spark, odd_docs):
    table = [(r.doc_id, r.text) for r in odd_docs.collect()]
    expected, counts, docs, best = digests_brute([t for _, t in table])
    found = align(odd_docs, BYTE_TOKENIZER, PIECE_MODEL)
    assert Counter(map(tuple, found.documents.collect())) == Counter((i, *e) for (i, _), e in zip(table, expected))
    assert {tuple(r) for r in found.pairs.collect()} == {
        (a, b, docs[a, b], n, n == best[b]) for (a, b), n in counts.items()}
    assert sum(e[0] > 0 for e in expected) > 100 and sum(e[0] == 0 for e in expected) == 5
    spelled = align(odd_docs.where("doc_id = 302"), BYTE_TOKENIZER, PIECE_MODEL, spelled=True).documents.first()
    assert hashlib.sha256(spelled.groups.encode()).hexdigest() == dict((i, e[6]) for (i, _), e in zip(table, expected))[302]


def test_alignment_query(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected, *_ = digests_brute([r.text for r in table])
    got = LLM_QUERIES["op11_token_alignment"](spark, f"{DATA}/sf0.001").collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, *e) for r, e in zip(table, expected))


def test_alignment_in_small_blocks(spark, odd_docs, monkeypatch):
    """Tables and entries that are let go of at every turn, blocks in several parts, long texts in stretches."""
    table = [(r.doc_id, r.text) for r in odd_docs.collect()]
    expected, *_ = digests_brute([t for _, t in table])
    model = open(PIECE_MODEL, "rb").read()
    text = open(BYTE_TOKENIZER, encoding="utf-8").read()
    for name, value in (("_MOST_PIECES", 20), ("_MOST_ENTRIES", 50), ("_STRETCH", 100)):
        monkeypatch.setattr(token_alignment, name, value)
    class Context:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(token_alignment.TaskContext, "get", staticmethod(lambda: Context))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in table], pa.int64()), "text": [t for _, t in table]})
    out = pa.Table.from_batches(token_alignment._tokenised(text, model, False, pa.int64())(iter([batch])))
    rows_ = out.filter(pa.compute.is_valid(out["place"])).to_pylist()
    assert [(r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) for r in rows_] == [
        (i, *e[:4], e[6]) for (i, _), e in zip(table, expected)]
    bits = out.filter(pa.compute.is_valid(out["a"])).select(["block", "a", "b", "plane", "bits"])
    bits = bits.sort_by([(c, "ascending") for c in ("block", "a", "b", "plane")])
    keys = list(zip(*(bits[c].to_pylist() for c in ("block", "a", "b", "plane"))))
    assert len(set(keys)) < len(keys)          # several parts are merged
    whole = pa.Table.from_batches(token_alignment._merged(bits.to_batches(max_chunksize=100)))
    counts = Counter()
    for r in whole.to_pylist():
        counts[r["a"], r["b"]] += r["links"]
    assert counts == digests_brute([t for _, t in table])[1]


def test_pieces_are_whole_texts():
    rng = random.Random(5)
    for text in ODD:
        for stretch in cut(text):
            assert all(p[0] == " " for p in stretch)
        assert "".join(p for s in cut(text) for p in s) == " " + text
    text = " ".join("".join(rng.choice("ab\n é") for _ in range(rng.randint(0, 6))) for _ in range(2000))
    assert "".join(p for s in cut(text) for p in s) == " " + text


def test_containers():
    rng = np.random.default_rng(1)
    doc = np.concatenate([np.sort(rng.choice(4096, n, replace=False)) for n in (1, 255, 256, 4096)])
    group = np.repeat([3, 4, 8, 9], [1, 255, 256, 4096])
    times = rng.integers(1, 6, len(doc))
    groups, planes, bits = containers(doc, times, group)
    maps = opened(pa.array(bits, pa.binary()))
    for g, p, m in zip(groups, planes, maps):
        own = group == g
        assert np.flatnonzero(np.unpackbits(m, bitorder="little")).tolist() == doc[own][times[own] >> p & 1 == 1].tolist()
    links = Counter()
    for g, p, n in zip(groups.tolist(), planes.tolist(), popcount(maps).tolist()):
        links[g] += n << p
    assert links == {g: int(times[group == g].sum()) for g in (3, 4, 8, 9)}
    assert closed(maps).to_pylist() == bits


def test_alignment_of_an_empty_table(spark, odd_docs):
    found = align(odd_docs.where("false"), BYTE_TOKENIZER, PIECE_MODEL)
    assert found.documents.collect() == [] and found.pairs.collect() == []


def test_pieces_table_is_bounded(monkeypatch):
    pieces_ = Pieces(open(BYTE_TOKENIZER, encoding="utf-8").read(), open(PIECE_MODEL, "rb").read())
    at = pieces_.of([" a", "\nb", " a", "\t x", " a"])
    assert at.tolist() == [0, 1, 0, 2, 0] and not pieces_.full
    monkeypatch.setattr(token_alignment, "_MOST_PIECES", 1)
    assert pieces_.full


def packed_brute(texts):
    t = Tokenizer.from_file(WORD_TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def check_packing(got, table, window):
    """Pieces cover every document and every window, and the ids are those of whole texts."""
    ids = packed_brute([t for _, t in table])
    total = sum(map(len, ids))
    of_doc = defaultdict(list)
    for r in got:
        of_doc[r.id].append(r)
    by_id = defaultdict(list)
    for (i, _), own in zip(table, ids):
        by_id[i].append(own)
    assert of_doc.keys() == by_id.keys()
    for i, all_rows in of_doc.items():
        # Rows may repeat an id: then each piece must fit one of its documents.
        left = sorted((len(own) for own in by_id[i]), reverse=True)
        assert sum(r.length for r in all_rows) == sum(left)
        for r in all_rows:
            assert any(len(own) == r.doc_tokens and zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes())
                       == r.ids_crc32 for own in by_id[i])
    at = defaultdict(list)
    for r in got:
        assert r.length > 0
        at[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    assert sorted(at) == list(range(len(at))) and padding == 0
    assert sum(n for s in at.values() for _, n in s) == total


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_edges(spark, odd_docs, window):
    table = [(r.doc_id, r.text) for r in odd_docs.collect()]
    stream = concatenate(odd_docs, WORD_TOKENIZER)
    got = pieces(stream, window).collect()
    check_packing(got, table, window)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    whole = {r.sequence_id: r.ids for r in sequences(stream, window).collect()}
    joined = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        joined[r.sequence_id] += r.ids
    assert whole == joined


def test_packing_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = LLM_QUERIES["op12_packing"](spark, f"{DATA}/sf0.001").withColumnRenamed("doc_id", "id").collect()
    check_packing(got, table, 2048)


def test_packing_long_text_and_empty_table(spark, odd_docs):
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "Beta", "gamma's", "x\ny", "", "Über"]) for _ in range(400_000))
    assert len(text) > 1 << 20
    docs = spark.createDataFrame([(1, text), (2, "w" * 300_000)], "doc_id long, text string")
    check_packing(pieces(concatenate(docs, WORD_TOKENIZER)).collect(), [(1, text), (2, "w" * 300_000)], 2048)
    empty = concatenate(odd_docs.where("false"), WORD_TOKENIZER)
    assert empty.total == 0 and pieces(empty).collect() == [] and sequences(empty).collect() == []


def test_words_that_are_let_go(monkeypatch):
    monkeypatch.setattr(packing, "_MOST_WORDS", 2)
    words = packing.WordIds(open(WORD_TOKENIZER, encoding="utf-8").read())
    for text in ("one two three", "four one", "", "two three"):
        ids, n = words.of(pa.array([text], pa.large_string()))
        assert ids.tolist() == packed_brute([text])[0][:-1] and n.tolist() == [len(ids)]


def test_cuts():
    for total in (0, 1, 63, 64, 100, 127, 128, 129, 1000):
        cuts = Cuts(total, 64)
        places = np.arange(total)
        number = cuts.number(places)
        assert (np.diff(number) >= 0).all()
        for w, n in Counter(number.tolist()).items():
            assert n == 64 or (n < 64 and n & (n - 1) == 0)
            assert places[number == w][0] == cuts.start(np.array(w)) and cuts.start(np.array(w + 1)) - cuts.start(np.array(w)) == n


def mined_brute(table):
    kept = [(i, None if i is None or lab is None else (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, v, lab in table]
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in kept
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    top = (1 << 63) - 1
    for a, label, v in kept:
        if a % 50:
            continue
        scored = sorted((-max(-top, min(top, sum(x * y for x, y in zip(v, w)))), i, lab)
                        for i, lab, w in kept if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [(i, -n) for n, i, lab in scored if lab != label and -50 * s <= -100 * n <= -95 * s][:3]
            out += [(a, p, rank, i, -s, n) for rank, (i, n) in enumerate(near, 1)]
    return out


def vector_rows():
    rng = random.Random(7)
    some = lambda n=16: [rng.randint(-40, 60) / 64 for _ in range(n)]
    out = [(i, some(), rng.randint(0, 4)) for i in range(260)]
    hot = some()
    out += [(1000 + i, hot, i % 3) for i in range(90)]           # one vector that many rows share
    out += [(50, some(), 1), (100, hot, 2), (100, hot, 2), (7, hot, 1)]          # rows that repeat an id, and a whole row
    out += [(2000, None, 1), (2050, some(), None), (None, some(), 1), (2100, [0.5, None] * 8, 1), (2150, [float("nan")] * 16, 2),
            (2200, [float("inf")] * 16, 2), (2250, some(11), 1), (2251, some(11), 1), (2252, some(11), 2), (2300, [], 1),
            (2301, [], 1), (2302, [], 2), (2350, [1e30] * 16, 3), (2351, [1e30] * 16, 3), (2352, [6e29] * 16, 4), (2353, [-1e30] * 16, 4),
            (2400, [3e7] * 16, 3), (2401, [2.9e7] * 16, 3), (2402, [2.5e7] * 16, 1), (-50, some(), 0)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "block_rows": 3}])
def test_hard_negatives_edges(spark, sizes):
    table = vector_rows()
    rows_ = [(i, v, lab, *EXTRA[:4]) for i, v, lab in table]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int, score long, rank string, dim int, block boolean")
    got = hard_negatives(df.repartition(3), **sizes).collect()
    assert Counter(map(tuple, got)) == Counter(mined_brute(table))
    assert hard_negatives(df.where("false")).collect() == []


def test_planes_give_products():
    rng = np.random.default_rng(3)
    for points, anchors in ((rng.integers(-300, 300, (50, 13)), rng.integers(-9, 9, (4, 13))),
                            (np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64)),
                            (np.array([[1 << 80, -1]], object), np.array([[3, 1 << 70]], object))):
        assert (scores(subset_sums(anchors), bit_planes(points)) == points @ anchors.T).all()
