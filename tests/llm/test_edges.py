"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oratorio.llm import fingerprints, html_extract, language_id, line_dedup, media, mixing, packing, pii, simhash, suffix_dedup
from oratorio.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, fp string, spans string, key string, part string, host string"
LONG = "word of a very long text " * 20000
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, LONG, "en", "a"), (5, "one two three four five six", "en", "a"), (5, "one two three four five six", "en", "a"),
    (6, "un deux trois quatre cinq six", "fr", "b"), (7, "x", None, "b"), (None, "no id here at all", "en", "b"), (8, "12345 !!", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["z"] * 6) for r in ROWS], SCHEMA).cache()


OPERATORS = {
    "mix": lambda d: mixing.mix(d, d.sparkSession.createDataFrame([], "labelled long, quality double")),
    "fingerprints": fingerprints.edited_fingerprints,
    "pii": pii.personal_data,
    "language": lambda d: language_id.with_language(d, language_id.learn(d)),
    "lines": line_dedup.without_repeated_lines,
    "pack": lambda d: packing.pack(d, packing.default_tokenizer()).dropDuplicates(["sequence_id", "offset"]),
    "suffix": suffix_dedup.remove_repeats,
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    if name in ("mix", "pii", "language", "lines", "suffix", "simhash"):
        assert len(rows) == len(ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_defined_results(docs):
    sim = {r.doc_id: r for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    assert sim[1].fingerprint == sim[2].fingerprint == sim[3].fingerprint == "0" * 16 and sim[3].component_id == 1
    lang = {r.doc_id: r for r in OPERATORS["language"](docs).where("doc_id is not null").collect()}
    assert lang[1].lang_pred == lang[2].lang_pred == lang[8].lang_pred == "und" and lang[6].lang_pred == "fr"
    gone = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).where("doc_id is not null").collect()}
    assert (gone[1].n_bytes, gone[1].n_removed) == (0, 0) and gone[4].n_removed == gone[4].n_bytes and gone[5].n_removed == 0
    fp = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).where("doc_id is not null").collect()}
    assert fp[1].fingerprint == fp[2].fingerprint and fp[1].near_next == 1.0


def test_long_digits_and_locals_are_linear(spark):
    t = ["7" * 60000, "a" * 60000 + "@", "1." * 30000, "+1" + "(" * 60000, "a.b@c.d@e.ff a@b.c._x@d.ee", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256"]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).where("doc_id >= 4")
    got = {r.doc_id: [(x.start, x.end) for x in r.spans if x.base] for r in out.collect()}
    assert got[4] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t[4])] and got[5] == [(0, 7), (8, 15)]


def test_pii_precision_and_recall(spark):
    """Planted spans that no base pattern has, among numbers and words that are none."""
    random = np.random.default_rng(4)
    names = ["jane", "otto.w", "maria_l", "kim7", "p.novak"]
    rows, want = [], {}
    for i in range(600):
        n = lambda k: "".join(map(str, random.integers(0, 10, k)))  # noqa: B023, E731
        name, kind = names[i % 5], i % 6
        if kind == 0:
            lead, span = "please write to my e-mail ", f"{name} [at] corp{i} [dot] com"
        elif kind == 1:
            lead, span = "call us, phone: ", f"({200 + int(n(2))}) {100 + i}-{n(4)}"
        elif kind == 2:
            lead, span = "the mobile is ", f"0{300 + int(n(2))} {n(4)} {n(4)}"
        elif kind == 3:
            lead, span = "the server has address ", ":".join(f"{x:x}" for x in random.integers(4096, 65536, 8))
        else:
            lead, span = [("see version ", f"555 {n(3)} {n(4)}"), ("meet me at noon at ", "place dot matter")][kind - 4]
        rows.append((i, f"{lead}{span} today, as agreed"))
        if kind < 4:
            want[i] = (len(lead), len(lead) + len(span))
    got = {r.doc_id: [(x.start, x.end) for x in r.spans if not x.base] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(span in got[i] for i, span in want.items())
    wrong = sum(len(v) for v in got.values()) - hits
    assert hits >= 0.9 * len(want) and hits >= 0.9 * (hits + wrong), (hits, wrong)
    text = spark.createDataFrame([(1, "mail a@b.co now")], "doc_id long, text string")
    assert pii.personal_data(text).join(text, "doc_id").select(pii.masked(F.col("text"), F.col("spans")).alias("t")).first().t == "mail <email> now"


def test_many_spans_in_one_text(spark):
    """Places are found in about linear time, and are those of the plain patterns."""
    text = " ".join(f"user{i}@host{i}.com" for i in range(20000))
    started = time.monotonic()
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.monotonic() - started < 30
    assert [(x.start, x.end) for x in row.spans] == [m.span() for m in re.finditer(r"\S+", text)]


def test_repeated_runs_of_lines(spark):
    a, b, c, d = "alpha beta gamma", "delta epsilon", "zeta eta theta", "iota kappa"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{a}\n{b}\n{c}\n{d}"), (2, f"intro here\n{a}\n\n{b}\n{c}\nend"), (3, f"{b}\nother\n{a}\nmore\n{d}"), (4, long), (5, f"x\n{long}\ny"), (6, f"{b}\n{c}\n{d}\nlast")]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "intro here\n\nend", 3: rows[2][1], 4: long, 5: "x\ny", 6: "last"}


def _brute_lines(texts):
    """The lines that go, found plainly: selected grams, first places, and a walk both ways along each diagonal."""
    docs = [[(i, s.strip()) for i, s in enumerate(t.split("\n")) if s.strip()] for t in texts]
    h = [[hashlib.md5(s.encode()).hexdigest() for _, s in d] for d in docs]
    long = [[len(s.split()) >= 50 for _, s in d] for d in docs]
    first, seeds = {}, []
    for r, x in enumerate(h):
        g = [hashlib.md5((p + q).encode()).hexdigest() for p, q in zip(x, x[1:], strict=False)]
        picked = {w + max(k for k in range(len(g[w : w + 2])) if g[w + k] == min(g[w : w + 2])) for w in range(max(1, len(g) - 1)) if g}
        for key, at, size in [(g[k], k, 2) for k in sorted(picked)] + [(("long", x[k]), k, 1) for k in range(len(x)) if long[r][k]]:
            if key in first:
                seeds.append((r, at, size, *first[key]))
            else:
                first[key] = (r, at)
    spans = {}
    for r, at, size, a, q in seeds:
        low, high = spans.get((r, a, at - q), (at, at + size - 1))
        spans[r, a, at - q] = min(low, at), max(high, at + size - 1)
    gone = [set() for _ in texts]
    for (r, a, d), (low, high) in spans.items():
        while low > 0 and low - d > 0 and h[r][low - 1] == h[a][low - 1 - d]:
            low -= 1
        while high + 1 < len(h[r]) and high + 1 - d < len(h[a]) and h[r][high + 1] == h[a][high + 1 - d]:
            high += 1
        same = {k for k in range(low, high + 1) if h[r][k] == h[a][k - d]}
        gone[r] |= {docs[r][k][0] for k in same if k - 1 in same or k + 1 in same or long[r][k]}
    return ["\n".join(s for i, s in enumerate(t.split("\n")) if i not in g) for t, g in zip(texts, gone, strict=True)]


def test_lines_against_brute_force(spark):
    random = np.random.default_rng(6)
    pool = [f"line {k} of the pool" for k in range(12)] + [" ".join(f"long{k}" for k in range(55)), ""]
    passage = [f"passage {k}" for k in range(30)]
    texts = ["\n".join(pool[k] for k in random.integers(0, len(pool), n)) for n in (0, 1, 2, 3, 5, 9, 40, 60)]
    texts += ["\n".join([f"own {n}", *passage[n : 30 - n], f"end {n}"]) for n in range(4)] + ["same\n" * 6]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[k] for k in range(len(texts))] == _brute_lines(texts)


def test_line_ties(spark):
    """Rows without a doc_id come last; of repeated rows the first keeps its lines."""
    run = "one two\nthree four\nfive six"
    docs = spark.createDataFrame([(None, run, 1, "z"), (7, run, 2, "z"), (7, run, 3, "z"), (None, None, 4, "z")], "doc_id long, text string, row long, h string").coalesce(1)
    got = {r.row: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {1: "", 2: run, 3: "", 4: None}


PAGE = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body><header class="site">Site name</header>
<nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies</div><div class="wrap"><main><article class="post-{i}"><header><h1>Head&nbsp;line {i}</h1></header>
<p>First  paragraph &amp; <b>bold</b> text<br>same block, quite long enough to count as the text of the page.</p><div class="ad">Buy now</div><p>Second one &lt;ok&gt; of number {i}, also long enough to count.
<ul><li>point a<li>point b</ul><form><input value="x"> Search</form><section class="comments"><p>A reader says that this is a very long comment indeed, longer than the article itself, and on and on it goes.</p></section></article></main>
<aside>Related things</aside></div><footer>&copy; foot</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"https://user@Host.example:80/p/{i}", PAGE.replace("{i}", str(i))) for i in range(6)] + [(10, None, "<p>only one"), (11, "x", ""), (12, "http://h/a", None), (13, "http://h/b", "plain &amp; text <p"), (14, "http://h/c", "<div><p>a</p><p hidden>b</p><p>c d</div>")]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1))).collect()}
    want = "Head line 3\nFirst paragraph & bold text same block, quite long enough to count as the text of the page.\nSecond one <ok> of number 3, also long enough to count.\npoint a\npoint b"
    assert got[3].text == want and got[3].n_chars == len(want)
    assert [got[i].text for i in (10, 11, 12, 13, 14)] == ["only one", "", "", "plain & text", "a\nc d"]
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_images(spark):
    import struct
    import zlib

    a = (np.arange(40 * 30) % 251).reshape(40, 30).astype(np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 40, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in a))) + chunk(b"IEND", b"")
    assert (media.decode(png) == a).all() and (media.decode(media.encode(a.astype(float))) == a).all()
    assert media.decode(None) is None and media.decode(b"P5 2") is None and media.decode(b"\x89PNG\r\n\x1a\nxx") is None
    rows = spark.createDataFrame([(1, None), (2, b"junk"), (3, media.drawn([float(i * i % 11) for i in range(64)]))], "id long, media binary")
    out = {r.id: r for r in media.described(rows, "bigint").collect()}
    assert out[1].digest is None and out[2].x == [] and out[3].digest and len(out[3].x) == len(out[3].d0) > 0
    assert media.decode(b"P5 2 1 65535\n" + bytes(4)) is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_targets(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, size long")
    t = {r.source: r.target for r in mixing.source_targets(s).collect()}
    assert t["a"] == 20 and t["c"] == 0 and sum(t.values()) == pytest.approx(1665) and t[None] == 200


def _least_of_groups(texts):
    """By all pairs: the smallest doc_id of each group of texts of similarity 0.8 or more."""
    own = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w := t.lower().split()) >= 5 else {tuple(w)} - {()} for i, t in texts.items()}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(own):
        for j in sorted(own):
            if i < j and (own[i] or own[j]) is not None and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in own}


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, lines string, start string, row string, __row string, c0 string, at string"


@pytest.mark.parametrize("k", range(5))
def test_stages_on_hard_rows(spark, sf, k):
    """Nulls, repeated ids and rows, empty tables and clashing names: nothing fails, columns stay."""
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, *["z"] * 6) for r in ROWS] + [(5, "another text of the same doc id", "en", "a", 5, 1, 2, *["z"] * 6)], STAGE_SCHEMA)
    name, stage = corpus_pipeline.STAGES[k]
    out, empty = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
    assert empty.count() == 0
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns and empty.columns == docs.columns and all(r["__row"] == "z" for r in rows)
    if name == "line_dedup":
        assert len(rows) == docs.count()
    if name == "simhash_near_dedup":  # null, empty and blank texts are one, as are the two rows of 5
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in {x[:2] for x in ROWS if x[0] not in (2, 3)} | {(5, "another text of the same doc id")})
    if name == "mix_sources":  # each row by itself, also those without a doc_id
        want = sum(r.taken for r in mixing.mix(docs, mixing.quality_of(spark, sf)).collect())
        assert sum(len((r.text or "").split()) for r in rows) == want


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + "<p>the text in the middle of it</p>" + "</div>" * 3000
    rows = [(1, "http://a/1", deep), (1, "http://a/1", deep), (2, "http://a/2", "<" * 500), (None, None, "<p>x")]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "x"), (1, "the text in the middle of it"), (1, "the text in the middle of it"), (2, "<" * 500)]


def test_op2_hard_rows(spark, tmp_path):
    vector = [float(i * i % 11) for i in range(64)]
    rows = [(50, vector, "z"), (50, vector, "z"), (51, None, "z"), (100, [], "z"), (None, vector, "z"), (3, vector, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = media.op2_image_copies(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.class_id for r in got if r.vec_id in (50, 3)} == {3}
    assert all(r.n_links == 0 for r in got if r.vec_id == 100)
    frame.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert media.op2_image_copies(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns), name
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids and ids <= before, name
        if name == "language_id":
            assert ids == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
        if name == "simhash_near_dedup":
            assert ids == _least_of_groups({r.doc_id: r.text for r in docs.collect()})
        docs, before = spark.createDataFrame(rows, docs.schema), ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == len(before)


def test_mixing_stage_takes_what_it_says(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.mix(docs, mixing.quality_of(spark, sf)).collect() if r.taken}
    got = {r.doc_id: r.n for r in mixing.mixing_stage(spark, docs, sf).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == want
