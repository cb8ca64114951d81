"""Source audit, source mix and spelling variants against brute force or SQL,
on tables with nulls, empty, long and repeated texts, ties and other columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import source_audit, source_mix, spelling

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n long, rank int, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variant(word):
    at, letter = RNG.randrange(len(word)), RNG.choice("abcéÿÀ÷")
    return RNG.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


STEMS = ["".join(RNG.choice("abcdéÀ") for _ in range(RNG.randint(5, 9))) for _ in range(60)]
WORDS = [*STEMS, *(variant(w) for w in STEMS for _ in range(4)), "日本", "aaaaaaa", "aaaaaa", "aaaaaaaa", "Zebra", "q" * 3000]
WEIGHTS = [1 / (1 + i % 83) for i in range(len(WORDS))]


def text(n):
    return " ".join(RNG.choice([w, w, w.upper(), f"{w},7_"]) for w in RNG.choices(WORDS, WEIGHTS, k=n))


TEXTS = [text(RNG.randint(1, 120)) for _ in range(150)]
TEXTS += [TEXTS[0], TEXTS[0], text(6000), "", None, " \n\t ", "1 2 3", "x"]
ROWS = [(i, t, [None, "en", "en", "en", "de"][i % 5], ["hot", "hot", "b", None, "c", "d"][i % 6], 1, 2, "x") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[3], (None, TEXTS[4], "en", "hot", 0, 0, None), (900, "1", "xx", "lone", 0, 0, None), (901, "un deux", "en", "no_words", 0, 0, None), (902, "", "en", "empty", 0, 0, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_sql(sql):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", [r[:4] for r in ROWS])
    got = con.sql(sql)
    return got.columns, sorted(got.fetchall(), key=repr)


def audit_brute(rows, least, top):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source, *_ in rows:
        t, lang, source = (t or "").translate(LOWER), lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, d in df[lang].items() if d >= least]
        others = sorted(s for g, s in groups if g == lang)

        def share(have, t, kept=kept):
            return 1 + 10**9 * (have[t] + 1) // (sum(have[x] for x in kept) + len(kept))

        whole = Counter()
        for s in others:
            whole.update(counts[lang, s])
        p = {t: share(counts[lang, source], t) for t in kept}
        pairs = []
        for s in others:
            if s != source:
                q = {t: share(counts[lang, s], t) for t in kept}
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s))
        terms = [(-((p[t] - q) ** 2 // q), t) for t in kept if counts[lang, source][t] and p[t] > (q := share(whole, t))]
        for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
            out += [(lang, source, part, item, -v, i) for i, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1)]
    return out


def test_op11(docs, none):
    columns, want = by_sql(source_audit.AUDIT_SQL)
    got = source_audit.source_audit(docs)
    assert got.columns == columns
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == want == sorted(audit_brute(ROWS, 3, 200), key=repr)
    assert {r[1] for r in rows if r[0] == "en"} >= {"", "empty", "no_words"} and not any(r[0] == "xx" for r in rows)
    few = [tuple(r) for r in source_audit.source_audit(docs, least=40, top=2).collect()]
    assert sorted(few, key=repr) == sorted(audit_brute(ROWS, 40, 2), key=repr)
    nothing = [tuple(r) for r in source_audit.source_audit(docs, least=10**6).collect()]
    assert nothing and all(r[2] == "pair" and r[4] == 0 for r in nothing)
    assert source_audit.source_audit(none).collect() == []


def test_op11_without_broadcast(docs, monkeypatch):
    want = sorted((tuple(r) for r in source_audit.source_audit(docs).collect()), key=repr)
    monkeypatch.setattr(source_audit, "MOST_BROADCAST", 0)
    assert sorted((tuple(r) for r in source_audit.source_audit(docs).collect()), key=repr) == want


def test_op11_shares_stay_exact(spark):
    cases = [(10**13, 10**13 + 5), (0, 1), (6, 7), (123456789, 8 * 10**13), (8 * 10**13 - 1, 8 * 10**13)]
    rows = spark.createDataFrame(cases, "n long, m long").select("n", "m", F.expr(source_audit._share("n", "m")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.m for r in rows)


def targets_brute(sizes, weights, share, epochs):
    budget, free = Fraction(share) * sum(sizes), set(range(len(sizes)))
    while free:
        level = (budget - sum(epochs * sizes[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i % len(weights)] for i in free)
        over = {i for i in free if epochs * sizes[i] < weights[i % len(weights)] * level}
        if not over:
            return [float(weights[i % len(weights)] * level) if i in free else float(epochs * sizes[i]) for i in range(len(sizes))]
        free -= over
    return [float(epochs * s) for s in sizes]


@pytest.mark.parametrize("roots", [source_mix.ROOTS, 3.0])
def test_op12(docs, none, monkeypatch, roots):
    monkeypatch.setattr(source_mix, "ROOTS", roots)
    columns, want = by_sql(source_mix.MIX_SQL)
    got = source_mix.mixed_documents(docs)
    assert got.columns == columns
    rows = got.collect()
    assert sorted((tuple(r) for r in rows), key=repr) == want
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for r in rows if r.doc_id is not None and r.doc_id < 150 for t in [TEXTS[r.doc_id]])
    assert sum(r.taken for r in rows) == 3 * sum(r["size"] for r in rows) // 2
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert source_mix.mixed_documents(none).collect() == []


def test_op12_order_and_targets(docs, monkeypatch):
    monkeypatch.setattr(source_mix, "MOST_BROADCAST", 0)
    for weights, share, epochs in (((3, 1, 2), 1.5, 2), ((1, 50), 0.5, 1), ((1, 2, 4, 8, 16), 2.9, 3), ((1,), 2.0, 2)):
        mix = source_mix.mix_sources(docs, weights, share, epochs).orderBy("start").collect()
        sizes, taken, most, named = Counter(), Counter(), Counter(), {}
        for r in mix:
            taken[r.number] += r.taken
            sizes[r.number], named[r.number] = r.source_size, r.target
            most[r.number] = max(most[r.number], r["size"])
        order = sorted({r[3] for r in ROWS}, key=lambda s: (s is None, s or ""))
        assert [next((r.source for r in mix if r.number == i), s) for i, s in enumerate(order)] == order
        want = targets_brute([sizes[i] for i in range(len(order))], weights, share, epochs)
        assert all(abs(named.get(i, 0) - w) < 1e-6 for i, w in enumerate(want))
        assert all(a.start + a["size"] == b.start and a.finish <= b.finish for a, b in zip(mix, mix[1:], strict=False))
        assert all(abs(taken[i] - w) <= sum(most.values()) for i, w in enumerate(want))


def spelling_brute(rows):
    counts = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run if h % 199 else run[:k] + run[k + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [x for x in words if near(w, x)] for w in words}
    best = {w: min(x, key=lambda y: (-words[y], y)) for w, x in found.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(found[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("letters, states", [(2_000_000, 1 << 18), (90, 128)])
def test_op13(docs, none, monkeypatch, letters, states):
    monkeypatch.setattr(spelling, "SHARD_LETTERS", letters)
    monkeypatch.setattr(spelling, "STATES", states)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 9000 if letters < 100 else 1 << 27)
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows, want = [tuple(r) for r in got.collect()], spelling_brute(ROWS)
    assert len(rows) == len(want) and set(rows) == want
    assert any(r[1] for r in rows) and any(len(r[0]) > 1000 for r in rows)
    assert spelling.spelling_variants(none).collect() == []


def test_op13_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(27)] + [("v", "w3"), ("u", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(chain).collect()} == {**{f"w{i}": "w27" for i in range(27)}, "v": "w27", "u": "w27"}


def test_op13_crc():
    words = [b"", b"a", b"zebra", b"x" * 300, "é".encode()]
    ends = np.cumsum([len(w) for w in words])
    data, prefix = np.frombuffer(b"".join(words), np.uint8), [zlib.crc32(f"{i}:".encode()) for i in range(5)]
    got = spelling.crc32s(np.array(prefix, np.uint32), data, ends - [len(w) for w in words], ends)
    assert got.tolist() == [zlib.crc32(w, p) for w, p in zip(words, prefix, strict=True)]
