"""The queries against brute-force versions on the smallest table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oratorio.llm import fingerprints, language_id, mixing, registry, simhash, suffix_dedup
from oratorio.llm.packing import default_tokenizer
from tests.oracle import connect, rows_of, rows_of_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, sf):
    return lambda name: registry.queries()[name](spark, sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(run, sf, name):
    assert rows_of(run(name)) == rows_of_sql(connect(sf), SQL[name])


def test_op1(run, docs):
    out = run("op1_mix_sources").collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.size == len(WORD.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
    total, want, left = sum(r.size for r in out), {}, sorted(by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by))}
    size = {s: sum(r.size for r in rs) for s, rs in by.items()}
    rest = 1.5 * total
    while left:  # share by weight; who is above twice its size is full, and the others share what is left
        level = rest / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > 2 * size[s]]
        for s in full or left:
            want[s] = 2 * size[s] if full else level * weight[s]
            rest -= want[s]
        left = [s for s in left if s not in want]
    for s, rs in by.items():
        assert rs[0].source_size == size[s] and rs[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in rs) - want[s]) <= 1


def test_op2_finds_its_own_source(run):
    asked = [r for r in run("op2_image_copies").collect() if r.vec_id % 50 == 0]
    assert asked and sum(r.found_id == r.class_id for r in asked) >= 0.9 * len(asked)


def test_op3(spark, run, docs):
    ids = sorted(docs)
    text = {i: docs[i].text or "" for i in ids}
    edit = {}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        q = len(text[i]) // 4
        edit[i] = text[i][: len(text[i]) - q] + text[j][:q]
    out = {r.doc_id: r for r in run("op3_weighted_fingerprints").collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(list(edit.items()), "doc_id long, text string")).collect()}

    def terms(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {}

    errors = []
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text[i]), hashlib.sha256(edit[i].encode()).hexdigest())
        assert r.edited_fingerprint == plain[i]  # the shared draws give what the edited text gives by itself
        assert (r.fingerprint == out[j].fingerprint) == (terms(text[i]) == terms(text[j])) or r.near_next > 0.8
        a, b = terms(text[i]), terms(edit[i])
        either = sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
        both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
        errors.append(r.near_edited - (both / either if either else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.12


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(kind, m):
        d = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if ok(kind, m[0]))


def test_op4(run, docs):
    names = list(PATTERNS)
    for r in run("op4_personal_data").collect():
        base = base_spans(docs[r.doc_id].text or "")
        line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_op5(spark, run, docs, sf):
    out = run("op5_language_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = language_id.learn(frame.where(language_id.fold() != 2))
    for r in out[:40]:  # counted plainly, each n-gram as bytes
        data = language_id.normalised(docs[r.doc_id].text)
        n = collections.Counter(data[i : i + k] for k in range(1, 5) for i in range(len(data) - k + 1))
        code = {g: int.from_bytes(g) | len(g) << 32 for g in n}
        own = sorted(n, key=lambda g: (-n[g], code[g]))[: profiles.top]
        place = {int(c): x for c, x in zip(profiles.codes, profiles.ranks, strict=True)}
        far = [sum(profiles.top if code[g] not in place or place[code[g]][k] == profiles.top else abs(int(place[code[g]][k]) - i) for i, g in enumerate(own)) for k in range(len(profiles.languages))]
        assert r.lang_pred == profiles.languages[int(np.argmin(far))]


def test_op8(run, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    pieces = collections.defaultdict(list)
    rows = run("op8_pack_sequences").collect()
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, d in docs.items():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for _, s in sorted(seqs.items()):
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        sizes.append(at)
    assert all(n == 2048 for n in sizes[:-1]) and sizes[-1] <= 2048


def brute_repeats(texts, length=200):
    seen = collections.Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for b in texts:
        runs = []
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + length
                else:
                    runs.append([s, s + length])
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + b[at:s], e
        out.append((len(b), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


@pytest.mark.parametrize("group,hot,most", [(256, 100_000, 1_000_000), (1, 3, 1_000_000), (256, 3, 0)])
def test_op9(spark, docs, monkeypatch, group, hot, most):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "MOST_HOT", most)
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 400, np.uint8)).decode()
    texts = [(docs[i].text or "")[:6000] for i in sorted(docs)[:60]]
    texts += [passage + f" tail {k} " * 20 for k in range(12)] + ["ab" * 400, "x" * 199, "x" * 201, passage[:230], passage[:199], "é" * 150, "", ("line of words " * 5 + "\n") * 9]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame, group=group).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts])


def roots(fps, distance=3):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(fps))]


def test_op10(run, docs):
    import xxhash

    out = {r.doc_id: r for r in run("op10_simhash_near_dedup").collect()}
    ids = sorted(docs)
    fps = []
    for i in ids:
        w = (docs[i].text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert [out[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [out[i].component_id for i in ids] == [ids[r] for r in roots(fps)]


def test_links_of_dense_buckets(spark):
    """A ball of close fingerprints, with bucket sizes that force the finer cuts."""
    rng = np.random.default_rng(1)
    fps = {0}
    while len(fps) < 300:
        x = sorted(fps)[rng.integers(len(fps))]
        fps.add(x ^ sum(1 << int(b) for b in rng.integers(0, 20, 2)))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(frame, dense=16).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    at = {f: i for i, f in enumerate(fps)}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(at[a]), find(at[b])))
        up[q] = p
    assert [find(i) for i in range(len(fps))] == roots(fps)


def test_mixing_orders_by_quality(spark):
    rows = [(i, "s", 10, 5.0 if i % 2 else 0.2) for i in range(2000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    targets = spark.createDataFrame([("s", 20000, 10000.0)], "source string, source_size long, target double")
    taken = mixing.mixed(sizes, targets).groupBy(F.col("doc_id") % 2).agg(F.sum("taken")).collect()
    by = {r[0]: r[1] for r in taken}
    assert by[1] > 4 * by[0] and by[0] + by[1] == 10000
