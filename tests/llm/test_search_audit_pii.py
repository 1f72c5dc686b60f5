"""Ranked lexical search, source divergence and personal data against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import divergence, lexical_search, personal_data

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{'abcdefghij'[i % 10]} x{i % 1000}" for i in range(80_000))
WORDS = "the The of Émile naïve x9 42 ß 日本 a b c d stone river-bed don't O'Neil FOX fox f_o_x 🙂 z".split()
SCHEMA = "doc_id long, text string, lang string, source string, term string, `N` long, item string, score long, rank long, h long, label long, salt long, base string"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def table(spark, n=150, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(40))) + rng.choice(["", ".", "\n", "\x00", "!?"]) for _ in range(n)]
    rows = [(rng.choice([None, *range(n)]) if i % 9 == 0 else i, t, rng.choice(["en", "EN", None, "de"]), rng.choice([None, "", "a", "b", "é", "Z"])) for i, t in enumerate(texts)]
    rows += [(n, None, "en", "a"), (n + 1, "", "xx", "only"), (n + 2, "  \n", None, None), (n + 3, LONG, "de", "a"), *rows[:7]]
    return rows, spark.createDataFrame([(*r, "t", 1, "i", 2, 3, 4, 5, 6, "b") for r in rows], SCHEMA)


# --- ranked lexical search ---------------------------------------------------------------------
def brute_search(docs, items, top=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    held = [(i, find(lower(t))) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(find(lower(t)))
    out = set()
    for item, terms in asked.items():
        scored = []
        for doc, w in held:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // length
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, k in terms.items() if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out |= {(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])}
    return out


@pytest.mark.parametrize("lot", [100_000, 6])
def test_search_equals_brute_force(spark, lot):
    rows, docs = table(spark)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=6))) for i in range(12)] + [(20, None), (21, "..."), (22, "nowhere"), (3, "fox wa"), (None, "x77 don't"), (5, "42"), (5, "42")]
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), lot_size=lot).collect()
    exp = brute_search([(r[0], r[1]) for r in rows], items)
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {tuple(r) for r in got} == exp


def test_search_of_empty_tables(spark):
    rows, docs = table(spark, 5)
    items = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.where("text is null"), items)):
        out = lexical_search.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_best_keeps_the_highest_however_they_come():
    rng = np.random.default_rng(3)
    item, score, doc = rng.integers(0, 5, 5000), rng.integers(1, 50, 5000), rng.permutation(5000)
    best = lexical_search.Best(7)
    for k in range(0, 5000, 61):
        part = slice(k, k + 61)
        best.add(item[part], score[part], doc[part], np.zeros(len(item[part]), dtype=bool))
        best.cut()
    got = {tuple(map(int, r[:3])) for r in zip(*best.parts[0], strict=True)}
    assert got == {(i, s, d) for x in range(5) for i, s, d in sorted(((int(a), int(b), int(c)) for a, b, c in zip(item, score, doc, strict=True) if a == x), key=lambda r: (-r[1], r[2]))[:7]}


# --- source divergence -------------------------------------------------------------------------
def brute_audit(rows, min_docs=10, top=10):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, words = lang or "", source or "", find(lower(text))
        groups[lang].add(source)
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= min_docs]
        whole = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})
        p = {}
        for s, c in [*((s, n[lang, s]) for s in sources), (None, whole)]:
            mass = sum(c[t] for t in kept) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // mass for t in kept}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if n[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])}
    return out


def test_audit_equals_brute_force(spark):
    rows, docs = table(spark, 300)
    for min_docs, width in ((10, 512), (1, 8)):
        got = divergence.audit(docs, min_docs=min_docs, width=width).collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_audit(rows, min_docs)


def test_audit_of_many_sources_and_of_none(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"t{'abcdefghijklmnop'[min(int(rng.expovariate(0.3)), 15)]}{'xyz'[i % 3]}" for _ in range(rng.randrange(12))), "en", f"s{i % 71}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(df, min_docs=3, width=16).collect()} == brute_audit(rows, 3)
    assert divergence.audit(df.limit(0)).count() == 0
    poor = [(i, "rare" if i else None, "en", f"s{i}") for i in range(3)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(poor, df.schema)).collect()}
    assert got == brute_audit(poor) and len(got) == 6 and {r[4] for r in got} == {0}


def test_tree_against_dense_matrix():
    rng = np.random.default_rng(1)
    for _ in range(40):
        rows, width = int(rng.integers(2, 20)), int(rng.integers(1, 40))
        dense = rng.poisson(0.15, (rows, width)) * rng.integers(1, 9, (rows, width))
        height = int(max(rows, width) - 1).bit_length()
        r, c = np.nonzero(dense)
        tree = divergence.Tree(r, c, dense[r, c], height)
        mass = dense.sum(1) + 2 * width
        p = 1 + 10**9 * (dense + 2) // mass[:, None]
        exp = ((p[:, None] - p[None]) ** 2 // (p[:, None] + p[None])).sum(2)
        upper = np.triu(np.ones((rows, rows), dtype=bool), 1)
        assert (divergence.pair_sums(tree, height, mass, width)[upper] == exp[upper]).all()
        split = rows // 2
        if split:
            assert (divergence.pair_sums(tree, height, mass, width, split)[:split, split:] == exp[:split, split:]).all()


def test_terms_come_in_pieces_and_levels_are_exact():
    raw = LONG.encode()
    assert sum(divergence.terms_of(raw, 1000), []) == sum(divergence.terms_of(raw), []) == re.findall(rb"[a-z\x80-\xff]+", raw)
    n, mass = np.array([0, 7, 10**12, 9 * 10**12]), np.array([3, 10**9 + 7, 10**12 + 11, 10**13])
    assert divergence.level(n, mass).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(n, mass, strict=True)]


# --- personal data -----------------------------------------------------------------------------
def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "-", "_", "+1", " ", "(", ")", "12", "255", "256", "0", "4929348385146306", "+1 (017) 555-7713", "10.0.0.1", "x@y.zz", "é", "١", "%", "\n", "-7", "5 5"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert personal_data.named(personal_data.base_spans(text)) == brute_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a" * 200_000 + "@" + "b." * 100_000, "+1" + "(" * 400_000, "1." * 200_000, "a@" * 200_000, "x1" * 200_000):
        personal_data.base_spans(text)
        field = personal_data.Field()
        field.add(0, text, [])
        assert len(field) <= 1


def trained():
    rng = random.Random(6)
    rows, counts = [], Counter()
    field = personal_data.Field()
    for k in range(600):
        number = f"{rng.randrange(10**15):015d}"
        number += next(c for c in "0123456789" if personal_data.luhn(number + c))
        text = rng.choice([f"pay with {number} now {number}", f"call +1 ({rng.randrange(900) + 100}) 555-{rng.randrange(9000) + 1000} now", f"mail a.{rng.randrange(99)}@mail.example.com", f"host 10.{rng.randrange(255)}.3.{rng.randrange(255)}", f"in {rng.randrange(1900, 2030)} and {rng.randrange(10**15)}", "version 3.0 of 12"])
        field.add(k, text, personal_data.base_spans(text))
    zero = [0] * 5
    for i, y in enumerate(field.label):
        rows.append((y, field.feats[i], field.label[i - 1] if field.next[i] else 0, field.label[i + 1] if i + 1 < len(field) and field.next[i + 1] else 0, [0, 0, 0, int(y == 3), 0], zero))
        counts[y] += 1
    return personal_data.fit(rows, counts)


def test_repeats_and_neighbours_get_the_label(spark):
    w = trained()
    card = "4929348385146306"
    assert personal_data.luhn(card)
    text = f"one {card}; see 12 {card} again. Call +1 (212) 555-0123, later 212 555-0123. In 2024 we sold 123456 of 4929348385146307."
    r = personal_data.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), weights=w).first()
    assert r.base == brute_base(text) and (r.n_card, r.n_phone, r.n_email, r.n_ip) == (1, 1, 0, 0)
    found = {(s.split(":")[0], text[slice(*map(int, s.split(":")[1:]))]) for s in r.spans.split(",")}
    assert set(r.base.split(",")) < set(r.spans.split(","))
    assert ("card", card) in found and r.spans.count("card:") == 2 and any(k == "phone" and "555-0123" in v and not v.startswith("+") for k, v in found)
    assert not any("2024" in v or "123456" == v or v.endswith("6307") for _, v in found)


def test_messages_give_exact_marginals_on_trees():
    rng = np.random.default_rng(5)
    w = personal_data.Weights()
    w.node, w.step, w.link = rng.normal(0, 0.5, w.node.shape), rng.normal(0, 1, w.step.shape), np.abs(rng.normal(0, 1, w.link.shape))
    field = personal_data.Field()
    text = "a 12 345-6789x then 345-6789x and 77 so und.34@m.de or und.34 end"
    field.add(0, text, [(text.index("77"), 3, text.index("77") + 2)])
    n = len(field)
    x, chain, equal, alike = field.arrays()
    assert n == 6 and len(chain) == 1 and len(equal) == 1
    unary = x.astype(float) @ w.node
    links = [(a, b, w.step) for a, b in chain] + [(a, b, np.diag(w.link[0])) for a, b in equal] + [(a, b, np.diag(w.link[1])) for a, b in alike]
    for i in range(n):
        unary[i] += w.step[0] * (not field.next[i]) + w.step[:, 0] * (i + 1 == n or not field.next[i + 1])
    total = np.zeros((n, 5))
    for y in itertools.product(range(5), repeat=n):
        if all(not k or k == v for k, v in zip(field.label, y, strict=True)):
            p = np.exp(sum(unary[i, v] for i, v in enumerate(y)) + sum(t[y[a], y[b]] for a, b, t in links))
            for i, v in enumerate(y):
                total[i, v] += p
    assert np.abs(personal_data.beliefs(field, w, 60) - total / total.sum(1, keepdims=True)).max() < 1e-6


def test_a_document_does_not_depend_on_its_batch(spark):
    w = trained()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in personal_data.find(docs, weights=w).collect()} == {tuple(r) for r in personal_data.find(docs.repartition(37), weights=w).collect()}


def test_query_and_awkward_rows(spark):
    rows, docs = table(spark, 20)
    extra = [(900, "x@y.zz " * 3), (901, None), (901, "10.0.0.1 " + LONG), (None, "+1 (212) 555-0123")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = personal_data.find(docs).collect()
    exp = Counter((i, brute_base(t or "")) for i, t in [*((r[0], r[1]) for r in rows), *extra])
    assert Counter((r.doc_id, r.base) for r in got) == exp
    assert all(set(r.base.split(",")) <= set(r.spans.split(",")) for r in got if r.base)
    assert personal_data.find(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in personal_data.query(spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(brute_base(texts[r.doc_id]).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(list(filter(None, brute_base(texts[r.doc_id]).split(","))))
