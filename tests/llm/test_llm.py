"""Training-data operators: brute-force comparisons, round trips, held-out accuracy, and the awkward cases."""

from __future__ import annotations

import gzip
import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import ann_forest, bpe, html_text, line_dedup, mixing, ngram_jaccard, quality_knn, quality_rules, tool_calls, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, grp long"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "a null id with some more words here"), (6, LONG), (7, LONG), (8, "É é\u00a0x\x85y\x1cz"),
        (9, "same line that is long enough\nother"), (10, "Same line that is long enough \n<|endoftext|> b"), (11, "\tsame LINE that is long enough\n"),
    ]
    return spark.createDataFrame([(i, t, None, None if i in (2, 9) else f"s{(i or 0) % 3}", None, 5, "n", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- BPE ---------------------------------------------------------------------------------------
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_library_and_round_trips(spark, awkward):
    lib = library()
    for docs in (documents(spark).select("doc_id", "text"), awkward):
        texts = sorted((r.text or "" for r in docs.collect()), key=hash)
        rows = bpe.apply(docs, bpe.default_vocabulary()).collect()
        exp = Counter((tuple(e.ids), lib.decode(e.ids, skip_special_tokens=False)) for e in lib.encode_batch(texts, add_special_tokens=False))
        assert Counter((tuple(r.ids), r.decoded) for r in rows) == exp


def test_bpe_fuzz():
    lib, codec, rng = library(), bpe.Codec(bpe.compile_file(bpe.default_vocabulary())), random.Random(5)
    letters = "aaabcdeeehiilmnorstuxyz0123'’!.-éüßŒİǅΣς\u0308日🙂\u0085\x1c<|> \n"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(25))) + rng.choice(["", "aaaa", "lolol", "....", "<|endoftext|>q"]) * rng.randrange(4)
        assert codec.encode(s)[0] == lib.encode(s, add_special_tokens=False).ids, repr(s)


def test_automaton_against_merging():
    merges = [("a", "a"), ("a", "b"), ("b", "c"), ("aa", "b"), ("ab", "c"), ("aa", "aa"), ("bc", "a")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *["".join(m) for m in merges if "".join(m) not in ("aab", "abc")], "aab", "abc"])}
    auto = bpe.Automaton(vocab, merges, "")
    names = {i: t for t, i in vocab.items()}
    for n in range(1, 9):
        for code in range(3**n):
            word = "".join("abc"[code // 3**k % 3] for k in range(n))
            parts = list(word)
            for a, b in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (a, b):
                        parts[k : k + 2] = [a + b]
                    k += 1
            assert [names[i] for i in auto.word(word.encode())] == parts, word


def test_bpe_digests_and_empty(spark, nothing):
    row = bpe.apply(documents(spark).limit(1), bpe.default_vocabulary(), columns=("n_tokens", "ids_sha256", "ids")).first()
    assert row.n_tokens == len(row.ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, row.ids)).encode()).hexdigest()
    assert bpe.apply(nothing, bpe.default_vocabulary()).count() == 0


# --- mixing ------------------------------------------------------------------------------------
def test_mixing_meets_targets(spark):
    rows = mixing.mix(documents(spark)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part
    assert abs(sum(g[0].target for g in by.values()) - sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
    for g in by.values():
        assert abs(sum(r.taken for r in g) - g[0].target) < 1
    positions = [r.position for r in rows if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1


def test_mixing_fills_up_to_the_cap(spark):
    rows = [(i, "w " * 10, None, s, 0, 0, "", 0) for i, s in enumerate(["a"] + ["b"] * 40 + [None] * 9)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
    targets = {r.source: r["max(target)"] for r in got}
    assert targets["a"] == 30.0 and abs(targets["b"] / targets[None] - 2.0) < 1e-9 or targets[None] == 270.0
    assert sum(targets.values()) == pytest.approx(500)


def test_mixing_schedule_inverts(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 1.0), (0.3, 3.0), (1.0, 0.0))
    grid = np.linspace(0, 1, 20001)
    area = np.concatenate([[0], np.cumsum((np.interp(grid[1:], [0, 0.3, 1], [1, 3, 0]) + np.interp(grid[:-1], [0, 0.3, 1], [1, 3, 0])) / 2 * np.diff(grid))])
    for r in spark.range(0, 11).select((F.col("id") / 10).alias("y")).select("y", mixing._due(F.col("y"), knots).alias("t")).collect():
        assert abs(np.interp(r.t, grid, area) / area[-1] - r.y) < 1e-4


def test_mixing_takes_follow_their_schedules(spark):
    import corpus_pipeline

    # "a" has 5/8 of the weight and few words: it is taken three times. "b" is taken more than once, "c" in part.
    rows = [(100 * k + i, " ".join(["w"] * (5 + i % 4)), None, s, None) for k, (s, n) in enumerate((("a", 40), ("b", 30), ("c", 90))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.takes(docs).collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and len({(r.doc_id, r.take) for r in got}) == len(got)
    whole = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = Counter()
    for r in got:
        words[r.doc_id] += r.words
    assert words == Counter({k: v for k, v in whole.items() if v}) and max(r.take for r in got) == 2
    for turn, source in enumerate("abc"):
        (_, r0), (_, r1) = mixing.SCHEDULES[turn]
        before = 0
        for r in (r for r in got if r.source == source):
            demand = (r0 * r.position + (r1 - r0) * r.position**2 / 2) / ((r0 + r1) / 2) * r.target
            assert abs(demand - before) < 1e-6 * r.target
            before += r.words
        assert abs(before - r.target) < 1
    # The stage keeps whole takes and partial ones from half on, in the same order, copies apart.
    kept = [r.doc_id for r in got if 2 * r.words >= r.size]
    stage = [r.doc_id for r in corpus_pipeline.mixed(spark, docs, SF).collect()]
    assert stage == kept and not any(x == y for x, y in zip(stage, stage[1:]))
    assert max(i for i, k in enumerate(stage) if k < 100) > 0.9 * len(stage)


def test_mixing_awkward(spark, awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == 13 and {r.doc_id for r in rows if r.size == 0} == {1, 2, 3} and all(r.taken == 0 for r in rows if r.size == 0)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(awkward).collect()), key=str)
    assert mixing.mix(nothing).count() == 0


# --- nearest neighbours ------------------------------------------------------------------------
def brute(vectors: dict, queries, n=20):
    ids, m = np.array(list(vectors)), np.array(list(vectors.values()))
    out = {}
    for q in queries:
        s = m @ vectors[q]
        order = np.lexsort((ids, -s))
        out[q] = [(int(ids[i]), s[i]) for i in order if ids[i] != q][:n]
    return out


def test_ann_recall_on_clusters_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in centres[i % 30] * (1 + i % 3) + 0.3 * rng.standard_normal(16).astype(np.float32)]) for i in range(1500)]
    rows += [(5000 + i, [10 * x for x in rows[40][1]]) for i in range(200)]  # a group of copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute({i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}, [i for i, _ in rows if i % 20 == 0])
    got = defaultdict(list)
    for r in ann_forest.search(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert {len(v) for v in got.values()} == {20} and set(got) == set(want)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert [a for a, _ in got[5000]] == [*range(5001, 5021)]


def test_ann_exact_when_all_are_candidates(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0])
    got = ann_forest.search(df, lambda i: i % 20 == 0).collect()
    hits = sum(r.vec_id in {a for a, _ in want[r.query_id]} for r in got)
    assert hits / len(got) >= 0.9 and all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 for r in got)


def test_ann_awkward(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (7, [1.0, 1.0, 1.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id long, qid long")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann_forest.search(df, lambda i: i % 20 == 0).orderBy("query_id").collect()] == [(0, 1, 20), (20, 1, 0)]
    assert ann_forest.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


# --- quality classifier ------------------------------------------------------------------------
def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = {r.doc_id: r.quality for r in labels.collect()}
    held = docs.where((quality_knn.fold_of(docs.doc_id) == 1) & docs.doc_id.isin([i for i in judged if i % 3 == 0]))
    rows = quality_knn.score(held, quality_knn.train(docs, labels)).collect()
    assert len(rows) > 200 and all(0 <= r.score <= 1 for r in rows)
    right = [(r.score >= 0.5) == (judged[r.doc_id] == 1) for r in rows]
    assert np.mean(right) >= 0.97


def test_repetition_is_counted_to_the_end():
    third = lambda words: quality_knn.terms(" ".join(words))[quality_knn.BUCKETS + 2]
    varied = [f"w{i}" for i in range(1000)]
    assert third(varied) == 0 and third(varied[:150]) == 0
    assert third(varied[:200] + ["junk"] * 800) == pytest.approx(0.8 * 199 / 200)
    # The words after the last full window count too, and a longer text of the same kind gets the same value.
    assert third(varied[:200] + ["junk"] * 100) == pytest.approx(99 / 400)
    assert third(["a", "b"] * 300) == pytest.approx(third(["a", "b"] * 3000)) == pytest.approx(0.99)


def test_classifier_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (9, 7), (None, 1)], "doc_id long, quality int")
    rows = quality_knn.score(awkward, quality_knn.train(awkward, labels)).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    blank = quality_knn.score(awkward, quality_knn.train(awkward, labels.limit(0))).collect()
    assert {r.score for r in blank} == {0.5}
    assert quality_knn.score(nothing, quality_knn.train(nothing, labels)).count() == 0


# --- tool calls --------------------------------------------------------------------------------
def test_levels_chains_joins_and_cycles(spark):
    rng = random.Random(3)
    deps = {i: rng.sample(range(i), min(i, rng.choice([0, 1, 1, 2, 3]))) for i in range(50)} | {k: [k - 1] for k in range(50, 80)}
    deps |= {200: [201], 201: [200], 202: [201], 203: [202, 5], 204: [999]}

    def level(k, seen=()):
        below = None if k in seen else [level(x, (*seen, k)) for x in deps[k] if x in deps]
        return None if below is None or None in below else max((x + 1 for x in below), default=0)

    df = spark.createDataFrame([(str(k), [str(x) for x in v]) for k, v in deps.items()], "id string, after array<string>")
    assert {int(r.id): r.level for r in tool_calls.levels(df).collect()} == {k: level(k) for k in deps}


def test_tool_call_arguments(spark):
    cases = [
        ("a", "ask", '{"words": 3, "turn": 0, "chars": 9}', None), ("b", "ask", '{"turn": 0, "words": 3}', "chars is missing"), ("c", "ask", '{"chars": "9", "turn": 0, "words": 3}', "chars is not of type integer"),
        ("d", "ask", '{"chars": 401, "turn": 0, "words": 3}', "chars is over 400"), ("e", "ask", "[1]", "arguments are no object"), ("f", "ask", "{oops", "arguments are no object"), ("g", "ask", None, "arguments are no object"),
        ("h", "fly", "{}", "no schema"), ("i", "ask", '{"chars": 1, "turn": 0, "words": 1, "zzz": {}}', "unknown argument"),
    ]
    calls = spark.createDataFrame([(i, 1, n, a, [], "x") for i, n, a, _ in cases] + [("a", 2, "fly", "{}", [], "y"), (None, 1, "ask", "{}", [], "z")], "id string, seq long, name string, arguments string, after array<string>, content string")
    results = spark.createDataFrame([("a", 2, "late"), ("a", 1, 'say "hi"\n\u00e9'), ("zz", 1, "orphan"), (None, 1, "nobody")], "id string, seq long, content string")
    got = {r.id: r for r in tool_calls.link(calls, results).collect()}
    assert {i: got[i].problem for i, *_ in cases} == {i: p for i, _, _, p in cases}
    assert got["a"].json == '{"arguments":{"chars":9,"turn":0,"words":3},"id":"a","name":"ask","result":"say \\"hi\\"\\n\u00e9"}'
    assert got["f"].json == '{"arguments":null,"id":"f","name":"ask","result":null}' and None in got and len(got) == len(cases) + 1
    assert tool_calls.link(calls.limit(0), results.limit(0)).count() == 0


# --- n-gram join -------------------------------------------------------------------------------
def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    low = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        low[root(a)].append(i)
    return [(i, len(s), min(low[root(a)], default=None, key=lambda z: z if z is not None else 1e18)) for a, (i, s) in enumerate(sets)]


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    for k in range(150):  # a group of near copies around one text, at and around the threshold
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, "Some  short\ttext") for k in range(5)] + [(3000, "some short text")]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_jaccard_common_tokens_and_ranges(spark, monkeypatch):
    """Small lots, ranges and blocks: common tokens, many ranges and block pairs are all in use."""
    for name, value in (("COMMON", 4), ("LOT", 500), ("TOKENS", 400), ("BLOCK", 8)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rng = random.Random(1)
    rows = [(k, " ".join(f"t{i}" if rng.random() > 0.012 else f"e{k}.{i}" for i in range(60)) + f" footer of all the {k % 2} pages here") for k in range(60)]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_jaccard_awkward(spark, awkward, nothing):
    got = Counter((r.doc_id, r.component_id) for r in ngram_jaccard.join(awkward).collect())
    assert got[(1, 1)] == got[(2, 2)] == got[(3, 3)] == 1 and got[(4, 4)] == 1 and got[(5, 4)] == 2 and got[(7, 6)] == 1 and sum(got.values()) == 13
    kept = [r.doc_id for r in ngram_jaccard.representatives(awkward).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 4, 6, 8, 9, 10, 11] and None in kept
    assert ngram_jaccard.join(nothing).count() == 0 and ngram_jaccard.representatives(nothing).columns == nothing.columns


def test_components_of_links_that_change_when_computed_again(spark):
    from sparkloom.llm.components import components

    def forest(batches):
        import pyarrow as pa

        for _ in batches:
            order = list(range(40))
            random.SystemRandom().shuffle(order)
            yield pa.RecordBatch.from_arrays([pa.array(order[:-1], pa.int64()), pa.array(order[1:], pa.int64())], names=["a", "b"])

    links = spark.range(0, 1, 1, 1).mapInArrow(forest, "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(40)}


# --- line dedup --------------------------------------------------------------------------------
def test_line_dedup_rules(spark, awkward, nothing):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup(awkward).collect()}
    assert (9, 2, 1, "other") in got and (10, 2, 1, "<|endoftext|> b") in got and (11, 2, 0, "\tsame LINE that is long enough\n") in got
    assert (1, 1, 0, "") in got and (2, 1, 0, "") in got and line_dedup.dedup(awkward).count() == 13
    assert line_dedup.dedup(nothing).count() == 0


def test_line_dedup_length_counts_points(spark):
    rows = [(i, "é" * 20 + "\n" + "e" * 19) for i in range(3)]
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(0, 1), (1, 1), (2, 0)}


# --- WARC --------------------------------------------------------------------------------------
def record(i: int, body: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Type: application/http;msgtype=response\r\n"
    return (head + f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.fixture(scope="module")
def archive():
    rng = random.Random(1)
    return [record(i, rng.randbytes(rng.randrange(500))) for i in range(20)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_after_damage(archive, packed):
    parts = [gzip.compress(r) for r in archive] if packed else archive
    whole = b"".join(parts)
    assert sum(r[0] == "record" for r in warc.salvage(whole)) == 20
    for spoil in range(20):
        d = bytearray(whole)
        at = sum(map(len, parts[:spoil]))
        d[at + len(parts[spoil]) // 2] ^= 0xFF
        rows = list(warc.salvage(bytes(d)))
        ids = [r[4]["warc-record-id"] for r in rows if r[0] == "record"]
        assert set(ids) >= {f"<urn:page:{i}>" for i in range(20) if i != spoil}
        assert rows[0][1] == 0 and rows[-1][2] == len(d) and all(a[2] == b[1] for a, b in zip(rows, rows[1:], strict=False))
    assert [r[:3] for r in warc.salvage(b"junk" + whole)][0] == ("gap", 0, 4)
    assert list(warc.salvage(whole[:-30]))[-1][0] == "gap" and list(warc.salvage(b"")) == []


def test_salvage_inside_a_large_member(archive):
    rng = random.Random(4)
    d = bytearray(gzip.compress(b"".join(record(i, rng.randbytes(20_000)) for i in range(30))) + gzip.compress(archive[0]))
    d[400_000] ^= 1
    rows = list(warc.salvage(bytes(d)))
    assert sum(r[0] == "record" for r in rows) >= 15 and any(r[0] == "gap" for r in rows) and rows[-1][0] == "record"


def test_warc_round_trip(spark, tmp_path):
    same, page = "x" * 100, "<p>WARC/1.1\r\n\r\n</p> é " * 9
    rows = [(1, "http://a/\n1", same), (2, None, same), (None, "http://b", same), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", page), (8, "u", page), (8, "u", page)]
    warc.write(spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, _n int"), f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert {r.kind for r in got} == {"record"} and Counter(r.type for r in got) == Counter(response=6, revisit=4)
    texts = {r.record_id: bytes(r.payload).decode() for r in got if r.type == "response"}
    assert texts["<urn:page:1>"] == same and texts["<urn:page:7>"] == page and texts["<urn:page:5>"] == ""
    assert all(r.refers_to in ("<urn:page:1>", "<urn:page:7>") and r.payload_bytes == (100 if r.refers_to == "<urn:page:1>" else len(page.encode())) for r in got if r.type == "revisit")
    assert warc.gaps(warc.read(spark, f"{tmp_path}/w")).count() == 0
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert warc.read(spark, f"{tmp_path}/e").count() == 0


# --- quality rules -----------------------------------------------------------------------------
def plain_counts(t: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and re.search(r"[^\x20\x09-\x0D]", line) is not None
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_counts_equal_brute_force(spark, awkward):
    for docs in (documents(spark), awkward):
        for r in docs.join(quality_rules.score(docs).withColumnRenamed("doc_id", "k"), docs.doc_id.eqNullSafe(quality_rules.F.col("k"))).collect():
            exp = plain_counts(r.text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == exp
            assert r.base_failed == (exp[0] < 50 or 100 * exp[4] > 50 * exp[0]) and not (r.base_failed and r.kept)


def test_half_a_text_of_noise_or_filler_goes():
    import base64

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(1500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n // 3)).encode()[:n]
    noise = lambda n: base64.b64encode(rng.randbytes(n))[:n]
    compress = __import__("zstandard").ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False).compress
    within = lambda raw: quality_rules.bands(raw, compress)[3]
    assert not within(prose(4150) + noise(4000))
    for n in (512, 600, 900, 1024, 1500, 2048, 3000, 4095, 4096, 4200, 6000, 8191, 8192, 10_000, 12_288, 20_000, 40_000):
        assert within(prose(n))
        for bad in (noise(n // 2), (b"buy it now and save " * n)[: n // 2]):
            assert not within(prose(n - n // 2) + bad) and not within(bad + prose(n - n // 2))
            assert not within(prose(n // 8) + bad + prose(n - n // 2 - n // 8))
    for n in (1, 60, 128, 129, 200, 255, 256, 400):
        assert within(prose(n)), n
    # All bytes are in a chunk: what follows the last full step counts.
    assert quality_rules.bands(prose(9000) + noise(4096), compress)[1] > 0
    assert within(prose(60_000) + noise(4096))


def test_quality_verdicts(spark, nothing):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randrange(1, 5))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9)) for _ in range(900))
    filler = " ".join(f"aaaa is {b}" for b in range(10))
    rows = [(1, prose), (2, noise), (3, "spam " * 900), (4, None), (5, filler)]
    got = {r.doc_id: r.kept for r in quality_rules.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] and not any(got[i] for i in (2, 3, 4, 5))
    assert [r.doc_id for r in quality_rules.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]
    assert quality_rules.score(nothing).count() == 0 and quality_rules.keep(nothing).columns == nothing.columns


# --- HTML --------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{main}
<aside>About us</aside><div id="comments"><p>First comment, a rather long one that goes on.</p></div><footer>&copy; 2024 somebody</footer></body></html>"""


@pytest.mark.parametrize(
    ("main", "text"),
    [
        ("<article><h1>Big &amp; small</h1><p>One <b>bold<br>word</b>.<p>Two\n  lines &#233;</article>", "Big & small\nOne bold\nword.\nTwo lines é"),
        ("<div class=post><p><b>Only one paragraph here.</b></p></div>", "Only one paragraph here."),
        ("<main><section><h2>A</h2><p>first part of it</p></section><section><h2>B</h2><p>second part of it</p></section></main>", "A\nfirst part of it\nB\nsecond part of it"),
        ("<article><p>Text<div class='ad'>Buy now</div><p>more</p><ul><li>x<li>y</ul></article>", "Text\nmore\nx\ny"),
        ("", ""),
    ],
)
def test_html_main_text(main, text):
    assert html_text.extract(PAGE.replace("{main}", main)) == text


@pytest.mark.parametrize("wrapper", [
    '<div class="layout has-sidebar">', '<div id="content" class="no-sidebar">', '<div class="page with-nav">', '<div class="sidebar-layout">', "<form id=aspnet>", '<div class="share-enabled">',
])
@pytest.mark.parametrize("head", ["<h1>Head of it</h1>", ""])
def test_html_wrappers_keep_the_article(wrapper, head):
    article = "".join(f"<p>Paragraph {i} of the article has a number of words, and it has no links.</p>" for i in range(6))
    text = [*(["Head of it"] if head else []), *(f"Paragraph {i} of the article has a number of words, and it has no links." for i in range(6))]
    side = '<div class="sidebar"><a href="/">One</a> <a href="/">Two</a></div><div class="comments"><p>A comment.</p></div>'
    end = "</form>" if wrapper.startswith("<form") else "</div>"
    assert html_text.extract(f"<html><body>{wrapper}<div>{head}{article}</div>{side}{end}</body></html>").split("\n") == text


def test_html_long_comments_go():
    page = "<body><div><h1>Head</h1><p>The short text of the article.</p></div><div id=comments>" + "<p>Many words of a comment under it.</p>" * 20 + "</div></body>"
    assert "comment" not in html_text.extract(page)


def test_html_pages_and_awkward(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.text_of(pages, keep=("page_id", "url")).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        assert re.sub(r"\s", "", html.unescape(re.sub(r"<[^>]+>", "", article))) == re.sub(r"\s", "", r.text) and r.n_chars == len(r.text)
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words"), (3, "u", "plain words"), (4, "u", "<p>" * 20000 + "x"), (5, "u", "<div>" * 20000 + "deep"), (6, "u", "</b></p><a"), (None, "u", "<br>" * 9)]
    got = [(r.page_id, r.text) for r in html_text.text_of(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert got == [(1, ""), (2, ""), (3, "plain words"), (3, "plain words"), (4, "x"), (5, "deep"), (6, "<a"), (None, "")]


# --- pipeline ----------------------------------------------------------------------------------
def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as p

    docs = documents(spark)
    rows = [tuple(r) for r in docs.collect()]
    names, stages = docs.columns, dict(p.STAGES)
    comp = __import__("zstandard").ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False).compress
    kept = [r for r in rows if quality_rules.measure(r[1], comp)[6]]
    now = stages["quality_rules"](spark, docs, SF)
    assert now.columns == names and sorted(map(tuple, now.collect())) == sorted(kept)

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for r in kept:
        for line in r[1].split("\n"):
            holders[key(line)].add(r[0])
    gone = lambda k, i: len(k) >= 20 and len(holders[k]) >= 3 and i != max(holders[k])
    texts = {r[0]: "\n".join(x for x in r[1].split("\n") if not gone(key(x), r[0])) for r in kept}
    now = stages["line_dedup"](spark, spark.createDataFrame(kept, docs.schema), SF)
    assert now.columns == names and {r.doc_id: r.text for r in now.collect()} == texts

    firsts = {i for i, _, c in brute_components(list(texts.items())) if i == c}
    near = stages["ngram_jaccard"](spark, now, SF)
    assert near.columns == names and {r.doc_id for r in near.collect()} == firsts

    mixed = stages["mixing"](spark, near, SF)
    assert mixed.columns == names and {r.doc_id for r in mixed.collect()} <= firsts
    assert p.run(spark, SF).count() == mixed.count()
