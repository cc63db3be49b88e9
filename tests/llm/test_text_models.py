"""Language identification, piece sampling, HTML extraction, archives."""

import base64
import gzip
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from conftest import DATA
from llm_cases import SCHEMA, edge_texts, rows
from pyspark.sql import functions as F

from eventloom.llm import gru, warc
from eventloom.llm.catalog import PIECE_MODEL
from eventloom.llm.common import ship
from eventloom.llm import html_extract
from eventloom.llm.html_extract import extract_main_text, main_text
from eventloom.llm.language_id import fit, learnable, predict
from eventloom.llm.piece_sampling import Vocabulary, _Lattices, decode, decode_ids, encode, sample_batch


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(rows(edge_texts()), SCHEMA).repartition(3).cache()


def test_slope_of_the_network():
    rng = np.random.default_rng(0)
    model = gru.initial(3, 4, 0)
    bytes_, labels = rng.integers(0, 256, (7, 5)), np.array([0, 1, 2, 0, 1])
    bytes_[5:, 0] = gru.PAD
    _, slope = gru.gradients(model, bytes_, labels)
    for name, g in slope.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for e in (1e-2, -1e-2):
            moved = {n: x.copy() for n, x in model.items()}
            moved[name][at] += e
            losses.append(gru.gradients(moved, bytes_, labels)[0])
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.02)


@pytest.fixture(scope="module")
def language_model(spark):
    return fit(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"))


def test_languages_held_out(spark, language_model):
    table = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    got = predict(table, language_model).where(~learnable(F.col("row.doc_id"))).select(
        "row.lang", "lang_pred", "score").toPandas()
    assert len(got) > 2000 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_languages_edges(spark, docs, language_model):
    got = predict(docs, language_model).select("row.*", "lang_pred", "score").collect()
    assert len(got) == len(edge_texts()) and set(got[0].asDict()) == {*docs.columns, "lang_pred", "score"}
    for r in got:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0) and 0 <= r.score <= 1
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict(unlabelled, fit(unlabelled)).collect()} == {"und"}
    assert predict(docs.where("false"), fit(docs.where("false"))).collect() == []


def test_column_names_of_any_kind(spark, docs, language_model):
    odd = docs.withColumns({"a b:c,<d>": F.lit(1), "e-f": F.struct(F.lit(2).alias("g h>"))})
    got = predict(odd, language_model)
    assert got.schema["row"].dataType.fieldNames() == odd.columns and len(got.collect()) == len(edge_texts())
    read = decode(odd.select("a b:c,<d>", "e-f", F.array(F.lit(5)).alias("ids")).limit(3), PIECE_MODEL)
    assert read.columns == ["a b:c,<d>", "e-f", "ids", "decoded"] and len(read.collect()) == 3


def test_prediction_sees_the_text_only(docs, language_model):
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.lit(0).cast("long")})
    key = lambda df: sorted((str(r.row.text), r.lang_pred, r.score) for r in predict(df, language_model).collect())
    assert key(docs) == key(other)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PIECE_MODEL, "rb") as file:
        return Vocabulary(file.read())


def all_paths(vocabulary, text):
    """Every segmentation of a text without byte pieces, with its log chance."""
    text = vocabulary.normalised(text)

    def rest(at):
        if at == len(text):
            yield (), 0.0
            return
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in vocabulary.pieces:
                i, w = vocabulary.pieces[text[at:end]]
                for ids, weight in rest(end):
                    yield (i, *ids), w + weight

    paths = dict(rest(0))
    norm = math.log(sum(map(math.exp, paths.values())))
    return {p: w - norm for p, w in paths.items()}


def test_samples_follow_the_lattice(vocabulary):
    text, n, k = "the an", 6000, 3
    chance = {p: math.exp(w) for p, w in all_paths(vocabulary, text).items()}
    got = sample_batch(_Lattices(vocabulary), [text] * n, list(range(n)), k)
    first, second, mass = Counter(), Counter(), 0.0
    for found in got:
        paths = [tuple(ids.tolist()) for ids, *_ in found]
        assert len(set(paths)) == k
        values = [v for _, _, v, _ in found]
        assert values == sorted(values, reverse=True)
        for path, (_, log_prob, _, _) in zip(paths, found):
            assert log_prob == pytest.approx(math.log(chance[path]), abs=1e-9)
        first[paths[0]] += 1
        second[paths[1]] += 1
        mass += sum(math.exp(log_prob - log_inclusion) for _, log_prob, _, log_inclusion in found)
    for path, p in chance.items():
        then = sum(q * p / (1 - q) for other, q in chance.items() if other != path)
        assert first[path] / n == pytest.approx(p, abs=0.02)
        assert second[path] / n == pytest.approx(then, abs=0.02)
    assert mass / n == pytest.approx(1, abs=0.01)       # inclusion scores make the sum unbiased


def test_all_segmentations_come_when_there_are_few(vocabulary):
    chance = all_paths(vocabulary, "ab")
    (found,) = sample_batch(_Lattices(vocabulary), ["ab"], [1], 50)
    assert {tuple(ids.tolist()) for ids, *_ in found} == set(chance)
    assert all(x[3] == 0 for x in found)


def test_sharpness_ends_at_the_best_path(vocabulary):
    with open(PIECE_MODEL, "rb") as file:
        sharp = Vocabulary(file.read(), 60.0)
    (found,) = sample_batch(_Lattices(sharp), ["then and there"], [3], 1)
    paths = all_paths(vocabulary, "then and there")
    assert tuple(found[0][0].tolist()) == max(paths, key=paths.get)


def test_encode_and_decode(spark, docs):
    got = decode(encode(docs, PIECE_MODEL, 3), PIECE_MODEL).collect()
    texts, model = Counter((i, t or "") for i, t, _ in edge_texts()), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert Counter((r.id, r.decoded) for r in got if r["sample"] == 1) == texts      # an exact round trip
    per_row = Counter()
    for r in got:
        assert (r.id, r.decoded) in texts and r.log_prob <= 1e-9 and r.log_inclusion <= 0
        assert model.decode(list(r.ids)) == r.decoded or "\x00" in r.decoded
        per_row[r.id, r.decoded] += 1
    assert all(n == texts[key] * (1 if not key[1] else 3) for key, n in per_row.items() if not 0 < len(key[1]) < 6)
    again = encode(docs.repartition(6), PIECE_MODEL, 3, decoded=True).collect()
    assert Counter((r.id, r["sample"], r.decoded) for r in again) == Counter((r.id, r["sample"], r.decoded) for r in got)
    assert sorted((str(r.id), r["sample"], r.ids) for r in again) == sorted((str(r.id), r["sample"], r.ids) for r in got)
    assert encode(docs.where("false"), PIECE_MODEL).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "id int, ids array<int>")
    assert sorted(tuple(r) for r in decode(nulls, PIECE_MODEL).select("id", "decoded").collect()) == [(1, None), (2, "")]


def test_mark_for_a_space_reads_as_a_space(vocabulary):
    (found,) = sample_batch(_Lattices(vocabulary), ["a▁b  c"], [5], 1)
    ids = found[0][0]
    assert decode_ids(vocabulary, ids, np.array([0, len(ids)])) == ["a b  c"]


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies, of course, as all do. Agree?</div><!-- <p>gone</p> -->
<div class="ad">Buy now, and buy a lot, because it is cheap.</div>
{body}
<aside class="sidebar"><p>Most read, today and ever.</p></aside><form><label>Mail</label><input><button>Send</button></form>
<section id="comments"><article class="comment"><p>First! What a good article, thank you so much, really.</p></article></section>
<footer>&copy; all of us, 2024.</footer></body></html>"""
ARTICLE = ("<h1>Head&amp;line</h1><p>One <b>bold</b>\n  sentence&nbsp;here, with  an <a href='x'>anchor</a>.<br>Next line."
           "<p>Short.</p><ul><li>a<li>b</ul><blockquote>Quoted &eacute;t&#233; &lt;tag&gt;.</blockquote><p><i>Un</i>closed")
TEXT = "Head&line One bold sentence here, with an anchor. Next line. Short. a b Quoted été <tag>. Unclosed"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>", '<div id="content">{}</div>'])
def test_article_of_a_page(around):
    assert main_text(PAGE.format(body=around.format(ARTICLE))) == TEXT


def test_article_without_a_mark():
    long = "".join(f"<p>Sentence {i}, of a text that is long enough, and has marks; it says so.</p>" for i in range(12))
    got = main_text(PAGE.format(body=f"<div><div>{long}</div></div>"))
    assert got.startswith("Sentence 0,") and got.endswith("it says so.") and got.count("Sentence") == 12
    assert "cookies" not in got and "Buy" not in got and "First!" not in got


@pytest.mark.parametrize("page,text", [
    ('<div class="share-page"><article><p>One, two. Three.</p></article></div>', "One, two. Three."),
    ("x<!-->y<!--->z<!-- <p>no</p> --!>!", "xyz!"),
    ("<body><form><div><p>All of the page, in a form. As some do.</p><p>And more of it, too.</p></div></form></body>",
     "All of the page, in a form. As some do. And more of it, too."),
    ('<aside><article><p>Read this too, it is short.</p></article></aside><main><p>A long text, with marks; and so on. '
     'It goes on, and on.</p><p>Here as well, of course.</p></main>',
     "A long text, with marks; and so on. It goes on, and on. Here as well, of course."),
    ('<div class="comments-area"><p>First, of all. Yes!</p></div><article><p>Text.</p></article>', "Text."),
    ('<p class="post-date">3 May</p><div><p>A long text, with marks; and so on. It goes on, and on.</p><h2>A heading of it</h2>'
     "<p>And here, it ends. Or not.</p></div>",
     "A long text, with marks; and so on. It goes on, and on. A heading of it And here, it ends. Or not."),
])
def test_marks_are_weighed_against_ratios(page, text):
    assert main_text(page) == text


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(n):
        start = time.process_time()
        assert main_text("<div>a, b. " * n + "<table><td><p>x" * n).startswith("a, b.")
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 40 * seconds(1000) + 0.5


def scores_brute(page):
    """Scores from whole paths: every path is a tuple, every sum is over all blocks below it."""
    walk = html_extract._blocks(page)

    def path(node):
        return () if node < 0 else (*path(walk.parent[node]), node)

    held = {}
    for node, text, linked in walk.found:
        held.setdefault(path(node), []).append((max(0, len(text) - linked), len(re.findall(r"[.,;:!?、。，؟،]", text))))
    ratio = {p: math.log1p(sum(c for c, _ in x) / len(x) * (1 + sum(m for _, m in x) / len(x))) for p, x in held.items()}
    smooth = {}
    for p in ratio:
        near = [(math.exp(-0.5 * k ** 2), [v for q, v in ratio.items() if q[:len(p) - k] == p[:len(p) - k]])
                for k in range(min(len(p), 7))]
        smooth[p] = 0.5 * ratio[p] + 0.5 * sum(w * sum(x) for w, x in near) / sum(w * len(x) for w, x in near)
    cues = {p: walk.cue[p[-1]] for p in ratio}
    most = max([smooth[p] for p in smooth if cues[p] >= 0], default=0) or max(smooth.values(), default=1) or 1
    chars = sum(c for x in held.values() for c, _ in x)
    out = {}
    for p in smooth:
        share = 0 if 1 in cues.values() or cues[p] >= 0 else sum(
            c for q, x in held.items() if walk.against[p[-1]] in q for c, _ in x) / max(1, chars)
        out[p[-1]] = min(1, smooth[p] / most) + {1: 0.35, 0: 0, -1: -0.5 * (1 - share)}[cues[p]]
    return out


def test_ratios_against_whole_paths():
    pages = [PAGE.format(body=ARTICLE), PAGE.format(body=f"<main><div>{ARTICLE}</div></main>"), "<form><p>a, b.</p><ul><li>c<li>d</ul></form>"]
    pages += [r["html"] for r in pq.read_table(f"{DATA}/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    for page in pages:
        walk = html_extract._blocks(page)
        found, expected = html_extract.path_scores(walk), scores_brute(page)
        assert all(found[node] == pytest.approx(score, abs=1e-6) for node, score in expected.items())


def test_ratios_and_marks_both_decide_on_the_given_pages(monkeypatch):
    """Without ratios no path reaches the threshold; without marks other blocks come, and some go."""
    pages = pq.read_table(f"{DATA}/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    texts = [main_text(p) for p in pages]
    assert all(texts)
    monkeypatch.setattr(html_extract, "_cue", lambda tag, attributes: 0)
    assert sum(main_text(p) != t for p, t in zip(pages, texts)) > len(pages) / 2
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "_PUNCTUATION", re.compile("(?!)"))
    monkeypatch.setattr(html_extract.math, "log1p", lambda x: 0.0)
    assert not any(main_text(p) for p in pages)


def test_network_against_one_byte_at_a_time():
    """The same chances from a plain loop over the gates of one state, for each text by itself."""
    rng = np.random.default_rng(8)
    model = {k: v.astype(float) for k, v in gru.initial(3, 4, 2).items()}
    model["bias"] += rng.normal(0, 1, model["bias"].shape)
    bend = lambda x: x / (1 + abs(x))
    texts = [bytes(rng.integers(0, 256, n).tolist()) for n in (1, 5, 9)]
    codes = np.full((9, 3), gru.PAD)
    for i, t in enumerate(texts):
        codes[:len(t), i] = list(t)
    got = gru.label_positions({k: v.astype(np.float32) for k, v in model.items()}, codes)
    for i in range(3):
        states = {}
        for way, order in ((0, range(9)), (1, range(8, -1, -1))):
            state = [0.0] * 4
            for t in order:
                given, inner = model["embed"][way][:, codes[t, i]], model["inner"][way]
                own = [sum(inner[g][j] * state[j] for j in range(4)) for g in range(12)]
                z = [0.5 + 0.5 * bend(given[g] + own[g]) for g in range(4)]
                r = [0.5 + 0.5 * bend(given[4 + g] + own[4 + g]) for g in range(4)]
                new = [bend(given[8 + g] + r[g] * (own[8 + g] + model["bias"][way][g][0])) for g in range(4)]
                state = [new[g] + z[g] * (state[g] - new[g]) for g in range(4)]
                states[way, t] = state
        for t in range(len(texts[i])):
            both = states[0, t] + states[1, t]
            raw = [math.exp(sum(w * x for w, x in zip(model["out"][c], both)) + model["out_bias"][c][0]) for c in range(3)]
            assert got[t, :, i] == pytest.approx([x / sum(raw) for x in raw], abs=1e-4)


def test_workers_let_go_of_their_words(spark):
    """After a task a worker holds the vocabulary, and no lattices."""
    def left(batches):
        import pyarrow as pa

        from eventloom.llm import piece_sampling
        for batch in batches:
            edges = max([x.n_edges for x in piece_sampling._LATTICES.values()], default=0)
            yield pa.RecordBatch.from_pydict({"edges": pa.array([edges] * batch.num_rows, pa.int64())})

    ship(spark)
    docs = spark.createDataFrame([(i, f"some words {i} of many") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert encode(docs, PIECE_MODEL, 2).count() == 100
    assert {r.edges for r in spark.range(8).mapInArrow(left, "edges long").collect()} == {0}


def test_pages_edges(spark):
    ship(spark)
    pages = [(1, "u", None), (2, None, ""), (None, "u", "plain text only"), (4, "u", "<<<>>> & &bogus; </p></div>"), (4, "u", "<p>x"),
             (5, "u", "<script>never closed <p>x</p>"), (6, "u", "<article>" + "<p>word, word.</p>" * 20_000), (7, "u", "<div" * 3000)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = extract_main_text(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == by[5].text == "" and by[None].text == "plain text only"
    assert by[6].text == " ".join(["word, word."] * 20_000)
    assert extract_main_text(df.where("false")).collect() == []


def sha1_32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives(spark):
    ship(spark)
    pages = [(1, "http://a/é?x=%41 y", "<p>é</p>"), (2, None, None), (3, "u\r\nX-Injected: 1", ""), (4, "u", "dup dup dup"), (5, "u", "dup dup dup"),
             (6, "u", "dup dup dup"), (4, "u", "dup dup dup"), (None, "u", "dup dup dup"), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "z" * 3_000_000),
             (None, "u", "lone"), (None, "u", "lone")]
    df = spark.createDataFrame([(*p, 1, "clash") for p in pages], "page_id long, url string, html string, offset int, file string").repartition(3)
    for min_bytes in (0, 10**6):
        index = warc.write_archives(df, min_bytes=min_bytes, roll=1 << 20)
        assert [c for c in index.columns] == ["page_id", "file", "offset", "length", "url", "digest", "payload_bytes", "record_type", "refers_to"]
        got = warc.read_records(index, gap=100, most=1 << 16).collect()
        first = {"": 2, "dup dup dup": 4} if min_bytes == 0 else {}
        expected = Counter()
        for page, url, html in pages:
            leader = first.get(html or "")
            other = leader is not None and page != leader
            data = (html or "").encode()
            expected[page, url, "revisit" if other else "response", leader if other else None,
                     None if other else data, len(data), sha1_32(data)] += 1
        assert Counter((r.page_id, r.url, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload),
                        r.payload_bytes, r.payload_digest) for r in got) == expected
    some = warc.read_records(index.where("page_id in (1, 9)")).collect()
    assert sorted(r.page_id for r in some) == [1, 9]
    file, at, n = index.where("page_id = 1").select("file", "offset", "length").first()
    with open(file.removeprefix("file://").removeprefix("file:"), "rb") as archive:
        archive.seek(at)
        record = gzip.decompress(archive.read(n))
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith("<p>é</p>\r\n\r\n".encode())
    assert warc.read_records(warc.write_archives(df.where("false"))).collect() == []
