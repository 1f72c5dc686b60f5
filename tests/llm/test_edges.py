"""Training-data operators: cases at the edges (repeated and null ids, clashing names, damage, very long input) against brute force."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest

from sparkloom.llm import html_text, line_dedup, mixing, ngram_jaccard, quality_knn, quality_rules, tool_calls, warc

SF = "/root/testdata/sf0.001"
CLASHES = ["_k", "_T", "_gone", "_lines", "_s", "_b", "_ahead", "_turn", "_src", "_Digest", "_bucket", "_inside", "_tie", "_nth", "_size", "_take", "k", "t", "h", "g", "pos", "line", "n", "last", "src", "node", "grp", "position"]


# --- line dedup --------------------------------------------------------------------------------
def kept_lines(rows):
    """Plain Python: rows that share an id are one document, null ids too; positions are per row."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    last = lambda k: max(holders[k], key=lambda i: (i is not None, i or 0))
    stays = lambda i, k: len(k) < 20 or len(holders[k]) < 3 or i == last(k)
    return Counter((i, "\n".join(x for x in (t or "").split("\n") if stays(i, key(x)))) for i, t in rows)


def test_line_dedup_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    shared = [f"A shared line with its number {k} in it" for k in range(12)]
    rows = [(rng.choice([None, *range(12)]), "\n".join(rng.choice([*shared, "short", "", f"  own line of its own {rng.random()}", shared[0].upper() + " "]) for _ in range(rng.randrange(8)))) for _ in range(80)]
    rows += [(1, "only two documents hold this line"), (1, "only two documents hold this line"), (2, "only two documents hold this line")]
    rows += [(None, "only rows without an id hold this")] * 3 + [(7, rows[0][1])] * 3
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.kept_text) for r in got) == kept_lines(rows)
    assert all(r.n_lines - r.n_dropped == (r.kept_text.count("\n") + 1 if r.n_dropped < r.n_lines else 0) for r in got)


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line number {i} of a very long text" for i in range(60_000)]
    rows = [(i, "\n".join(lines)) for i in range(3)]
    began = time.time()
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(0, 60_000), (1, 60_000), (2, 0)}
    assert time.time() - began < 60


# --- clashing names ----------------------------------------------------------------------------
def test_clashing_columns_pass_through(spark):
    rows = [(i, f"a line that all the documents hold\nand {i % 3} some words", f"s{i % 2}", *range(len(CLASHES))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES))
    plain = docs.select("doc_id", "text", "source")
    given = tuple(range(len(CLASHES)))
    for run in (line_dedup.dedup, mixing.mix, ngram_jaccard.representatives):
        wide, slim = run(docs), run(plain)
        made = [c for c in slim.columns if c not in plain.columns]
        left = [c for c in CLASHES if c not in made]
        assert wide.select("doc_id", *made).exceptAll(slim.select("doc_id", *made)).isEmpty() and wide.count() == slim.count()
        assert {tuple(r) for r in wide.select(*left).collect()} == {tuple(v for c, v in zip(CLASHES, given, strict=True) if c not in made)}


def test_pipeline_keeps_columns_of_its_own_and_clashing_ones(spark):
    import corpus_pipeline as p

    words = lambda k: " ".join(f"{w}{(i * k) % 89}" for i, w in enumerate(["alpha", "beta", "gamma", "delta", "omega"] * 30))
    texts = [words(1), words(1), words(3), None, "", words(5) + "\n" + "a line that three documents share, word for word", words(7) + "\na line that three documents share, word for word", words(9) + "\na line that three documents share, word for word"]
    names = ["size", "n_lines", "n_dropped", "kept_text", "part", "copies", "position", "taken", "take", "words", "node", "component_id"]
    rows = [(i, t, "en", None if i == 6 else f"s{(i or 0) % 2}", 1, *range(len(names))) for i, t in [*enumerate(texts), (0, texts[0]), (None, words(11))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in names))
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == names, name
        assert {tuple(r) for r in docs.select(*names).collect()} == {tuple(range(len(names)))}, name
        assert docs.where("doc_id in (3, 4)").isEmpty(), name
    assert p.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


# --- mixing ------------------------------------------------------------------------------------
def test_targets_against_plain_sharing_out(spark):
    rng = random.Random(3)
    sizes = {f"h{k:04d}": rng.choice([0, 1, 5, 50, 500]) * rng.randrange(1, 9) for k in range(400)} | {None: 77}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "src string, size long")
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if level * weight[s] > 3 * sizes[s]}
        if more == full:
            break
        full = more
    got = {r.src: r.target for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(3 * sizes[s] if s in full else level * weight[s]) for s in sizes}


def test_mixing_by_known_sizes_and_small_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "taken", "position").collect()}
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"))
    monkeypatch.setattr(mixing, "BUCKET", 3)
    assert {tuple(r) for r in mixing.mix(sized, size="size").select("doc_id", "size", "taken", "position").collect()} == one


# --- n-gram join -------------------------------------------------------------------------------
def test_sets_of_texts_longer_than_a_stretch(monkeypatch):
    rng = random.Random(6)
    words = ["w" * rng.randrange(1, 30) + str(rng.randrange(50)) for _ in range(3000)] + ["x" * 5000]
    text = "".join(w + rng.choice([" ", "\n\t", "  "]) for w in words)
    whole = ngram_jaccard.set_of(text)
    for stretch in (1, 7, 100, 1000, len(text)):
        monkeypatch.setattr(ngram_jaccard, "STRETCH", stretch)
        assert np.array_equal(ngram_jaccard.set_of(text), whole)
    assert len(whole) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_groups_of_near_copies_around_pivots(spark, monkeypatch):
    """Two families that share prefix tokens, many members: pivots settle most, blocks find the rest."""
    from test_llm import brute_components

    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    rng = random.Random(2)
    rows = []
    for k in range(140):
        w = [f"{'ab'[k % 2]}{i}" if i > 40 else f"c{i}" for i in range(120)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(41, 120)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


# --- tool calls --------------------------------------------------------------------------------
def test_linked_calls_come_in_topological_order(spark):
    rng = random.Random(4)
    calls = [(str(i), 100 - i, "ask", None, [str(rng.randrange(i)) for _ in range(rng.randrange(3))] if i else []) for i in range(40)] + [("x", 0, "ask", None, ["x"])]
    df = spark.createDataFrame(calls, "id string, seq long, name string, arguments string, after array<string>")
    rows = tool_calls.link(df, df.limit(0).selectExpr("id", "seq", "name as content")).collect()
    at = {r.id: k for k, r in enumerate(rows)}
    assert all(at[d] < at[i] for i, _, _, _, after in calls for d in after if d != i) and rows[-1].id == "x" and rows[-1].level is None


# --- quality classifier ------------------------------------------------------------------------
def test_votes_against_brute_force():
    rng = np.random.default_rng(4)
    rows = np.abs(rng.standard_normal((120, quality_knn.BUCKETS + quality_knn.EXTRA))).astype(np.float32) * (rng.random((120, 1)) + 0.5)
    labels = (rng.random(120) < 0.4).astype(float)
    model = quality_knn.fit(rows.astype(np.float32), labels)
    block = np.vstack([rows[:20] + 0.1 * rng.standard_normal((20, rows.shape[1])), np.zeros((1, rows.shape[1]))]).astype(np.float32)
    got = quality_knn.vote(model, block)
    for x, score in zip(block, got, strict=True):
        z = (x * model["weight"]) @ model["project"]
        cosines = [max(0.0, float(z @ y) / (np.linalg.norm(z) or 1)) for y in model["latent"]]
        near = sorted(range(120), key=lambda i: -cosines[i])[: quality_knn.NEIGHBOURS]
        total = sum(cosines[i] ** quality_knn.POWER for i in near)
        want = sum(cosines[i] ** quality_knn.POWER * labels[i] for i in near) / total if total else labels.mean()
        assert score == pytest.approx(want, abs=1e-5)


# --- quality rules -----------------------------------------------------------------------------
def test_verdicts_against_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = lambda x: len(zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False).compress(x))

    def verdict(text: str) -> bool:
        raw = text.encode()
        outside = lambda x, table: not (lambda lo, hi: lo <= size(x) / len(x) <= hi)(*[(lo, hi) for least, lo, hi in table if len(x) >= least][-1])
        chunks = []
        if len(raw) > 128:
            long = 4096 if len(raw) >= 8192 else len(raw) // 2 if len(raw) >= 256 else 128
            at = 0
            while at < len(raw) - long:
                chunks.append(raw[at : at + long])
                at += long // 4
            chunks.append(raw[-long:])
        bad = sum(outside(c, quality_rules.CHUNK_BANDS) for c in chunks)
        return not outside(raw, quality_rules.WHOLE_BANDS) and (bad == 0 or 8 * bad < len(chunks))

    rows = docs.join(quality_rules.score(docs), "doc_id").where("text is not null and not base_failed").collect()
    assert len(rows) > 500 and all(r.kept == verdict(r.text) for r in rows)


# --- WARC --------------------------------------------------------------------------------------
def record(i: int, body: bytes, version: str = "1.1", more: str = "") -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n{more}Content-Type: application/http;msgtype=response\r\n"
    return (head + f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_records_of_a_member_with_a_wrong_checksum_stay():
    member = bytearray(gzip.compress(b"".join(record(i, b"some text %d " % i * 9) for i in range(30))))
    member[-6] ^= 1
    rows = list(warc.salvage(bytes(member)))
    assert [r[4]["warc-record-id"] for r in rows if r[0] == "record"] == [f"<urn:page:{i}>" for i in range(30)]
    assert [r[0] for r in rows].count("gap") == 1 and rows[-1][0] == "gap"
    after = bytes(member) + gzip.compress(record(99, b"x"))
    assert [r[0] for r in warc.salvage(after)] == ["record"] * 30 + ["gap", "record"]


def test_damage_near_the_end_of_a_member_costs_what_follows_it():
    rng = random.Random(3)
    member = bytearray(gzip.compress(b"".join(record(i, rng.randbytes(2000)) for i in range(30))))
    member[-3000] ^= 0x55
    found = [r[4]["warc-record-id"] for r in warc.salvage(bytes(member)) if r[0] == "record"]
    assert found[:27] == [f"<urn:page:{i}>" for i in range(27)] and len(set(found)) == len(found) < 30


def test_old_versions_and_long_headers(spark, tmp_path):
    data = b"".join(record(i, b"abc", v, f"WARC-Target-URI: http://a/{'x' * n}\r\n") for i, (v, n) in enumerate((("0.17", 3), ("0.18", 200_000), ("1.0", 70_000), ("1.1", 1))))
    assert [r[0] for r in warc.salvage(data)] == ["record"] * 4
    began = time.time()
    assert [r[0] for r in warc.salvage(b"WARC/1.1\r\na:b\r\n" * 30_000 + data)] == ["gap"] + ["record"] * 4
    assert time.time() - began < 30
    pages = spark.createDataFrame([(1, "http://b/" + "y" * 100_000, "<p>long</p>")], "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    (row,) = warc.read(spark, f"{tmp_path}/w").collect()
    assert row.kind == "record" and len(row.uri) == 100_009 and bytes(row.payload) == b"<p>long</p>"


# --- HTML --------------------------------------------------------------------------------------
def naive_density(x, body):
    """Density of an element by the formula, from counts made anew for each element."""
    def below(y):
        for k in y.kids:
            if type(k) is not str and not k.out:
                yield k
                yield from below(k)

    def chars(y):
        return sum(len("".join(unescape(k).split())) if type(k) is str else 0 if k.out else chars(k) for k in y.kids)

    def link_chars(y):
        return sum(0 if type(k) is str or k.out else chars(k) if k.tag == "a" else link_chars(k) for k in y.kids)

    c, lc, bc, blc = chars(x), link_chars(x), chars(body), link_chars(body)
    if not c:
        return 0.0
    t, lt = max(1, sum(k.tag in html_text.COUNTED for k in below(x))), max(1, sum(k.tag == "a" for k in below(x)))
    base = math.log(c * lc / max(c - lc, 1) + blc / bc * c + math.e)
    return c / t * math.log(max(c * t / (max(lc, 1) * lt), 1.0)) / max(math.log(base) if base > 1 else 0.0, 1.0)


def test_density_against_plain_recursion():
    rng = random.Random(12)

    def tree(depth):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if depth == 0 or kind < 0.35:
                parts.append("word " * rng.randrange(1, 30))
            elif kind < 0.5:
                parts.append(f'<a href="x">{"link " * rng.randrange(1, 6)}</a>')
            else:
                tag = rng.choice(["div", "section", "p", "ul", "blockquote"]) if depth > 1 else "p"
                parts.append(f"<{tag}>{tree(depth - 1) if tag != 'p' else 'some <b>bold</b> text ' * rng.randrange(1, 20)}</{tag}>")
        return "".join(parts)

    for _ in range(150):
        root = html_text.parse(f"<html><body>{tree(4)}</body></html>")
        chosen = html_text.main_node(root)
        nodes = html_text._order(root)
        body = next(x for x in nodes if x.tag == "body")
        dense = {id(x): naive_density(x, body) for x in nodes}
        assert all(x.density == pytest.approx(dense[id(x)]) for x in nodes)
        counted = [x for x in nodes if x.tag in html_text.COUNTED and x.tag != "html"]
        up = {id(k): x for x in nodes for k in x.kids if type(k) is not str}
        path, threshold = max(counted, key=lambda x: dense[id(x)]), math.inf
        while True:
            threshold = min(threshold, dense[id(path)])
            if path is body:
                break
            path = up[id(path)]

        def total(x):
            return sum(dense[id(k)] if k.tag in html_text.COUNTED else total(k) for k in x.kids if type(k) is not str and not k.out)

        best = max((x for x in counted if dense[id(x)] >= threshold), key=total)
        if total(best):  # the chosen element is the one of the greatest sum, or around it
            inside, x = False, best
            while x is not None:
                inside |= x is chosen
                x = up.get(id(x))
            assert inside


def test_blocks_of_pages_in_order(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    joined = html_text.text_of(pages).join(pages.select("page_id", "html"), "page_id")
    for r in joined.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|br|table|tr|td|th|section)\b[^>]*>", article)
        want = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert r.text == "\n".join(x for x in want if x)


@pytest.mark.parametrize("page", ['<div class="x ' * 380_000, "<b " * 100_000, "<div>" * 60_000 + "<td></td>" * 60_000, "<b>" * 60_000 + "<div></div>" * 60_000, "<b <b " * 50_000 + '="> ">"'])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_text.extract(page)
    assert time.time() - began < 5


def test_names_inside_an_article():
    page = (
        "<body><nav>Menu</nav><article><header><h1>Head</h1><p>By somebody</p></header><p>Some text that goes on for long.</p><div id='side-effects'><p>Nausea and more.</p></div>"
        "<section class='related-work'><p>Others did it.</p></section><div class='related-posts'><a href=x>More</a></div><div class='ad'>Buy</div></article><header>Site</header></body>"
    )
    assert html_text.extract(page).split("\n") == ["Head", "By somebody", "Some text that goes on for long.", "Nausea and more.", "Others did it."]


# --- attribute values, repeated ids, word hashes -------------------------------------------------
def test_attribute_values_are_not_names():
    body = "".join(f"<p>Paragraph {k} with enough of its own words to be the article of this page.</p>" for k in range(4))
    for piece in (
        '<p>See <a href="/films/hidden-figures">Hidden Figures</a> today.</p>', '<p title="a hidden gem">A gem of a place.</p>', '<p data-hidden="false">Shown to all.</p>', '<p data-id="sidebar" data-role="form">Kept as well.</p>',
        "<p data-x='class=\"ad\"'>Quoted in quotes.</p>", '<p title="style=display:none">No style.</p>', "<p data-note=aria-hidden=true>Unquoted.</p>", '<p alt = "id=nav" lang = "en">Spaced out.</p>',
    ):
        for page in (f"<html><body><article><h1>T</h1>{body}{piece}</article></body></html>", f'<html><body><div title="Hidden costs" data-class="nav"><h1>T</h1>{body}{piece}</div></body></html>'):
            text = html_text.extract(page)
            assert re.sub(r"<[^>]*>", "", piece) in text and text.count("Paragraph") == 4, piece
    for piece in ('<p hidden>Gone</p>', '<p HIDDEN="">Gone</p>', "<p aria-hidden = 'true'>Gone</p>", '<p style="color: red; display : none">Gone</p>', "<div role=navigation>Gone</div>", '<div class=sidebar>Gone</div>'):
        assert "Gone" not in html_text.extract(f"<html><body><article><h1>T</h1>{body}{piece}</article></body></html>"), piece
    began = time.time()
    html_text.parse("<div " + " " * 300_000 + ">x</div><p " + "a=' " * 100_000 + ">y</p><p " + "= " * 100_000 + ">z")
    assert time.time() - began < 5


def brute_kept(rows):
    """Rows that stay: of each group of linked (id, text) rows the first by id (null last); equal rows count once; which text of an id stays in a tie is left open."""
    sets = [frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    kept = [i for i, (k, _) in enumerate(rows)]
    blank = Counter(rows[i] for i in kept if not sets[i])
    groups = defaultdict(list)
    for i in kept:
        if sets[i]:
            groups[group[i]].append(rows[i])
    return blank, [{r for r in g if (r[0] is None, r[0] or 0) == min((k is None, k or 0) for k, _ in g)} for g in groups.values()]


def test_repeated_ids_with_unlike_texts_all_stay(spark):
    rng = random.Random(12)
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    a, b, z, q = (text(k) for k in "abzq")
    near = a.rsplit(" ", 1)[0] + " other"
    fixed = [(1, a), (1, b), (3, a), (3, z), (5, q)]
    got = ngram_jaccard.representatives(spark.createDataFrame(fixed, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, a), (1, b), (3, z), (5, q)]
    rows = [*fixed, (1, a), (7, near), (None, near), (None, "lone text of a row without any id"), (2, None), (2, ""), (2, ""), (None, " "), (5, "x"), (6, "x")]
    rows += [(rng.choice([1, 4, 8, None]), text(rng.randrange(6))) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, _k string, _t0 int")
    out = [(r.doc_id, r.text) for r in ngram_jaccard.representatives(docs).collect()]
    blank, groups = brute_kept(rows)
    assert Counter(r for r in out if not (r[1] or "").split()) == blank
    worded = [r for r in out if (r[1] or "").split()]
    assert len(worded) == len(groups) and all(sum(r in g for r in worded) == 1 for g in groups)


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline as p

    parts = "the stone ri ver an ka lo mi ter es sun and wood ing of den far a bel con du".split()
    words = lambda k: " ".join("".join(random.Random(k * 1000 + i).choices(parts, k=2)) for i in range(150))
    rows = [(1, words(1)), (1, words(3)), (3, words(1)), (3, words(5)), (5, words(7)), (5, words(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:3]:
        docs = stage(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter({(1, words(1)), (1, words(3)), (3, words(5)), (5, words(7))})


def test_words_alike_under_polynomials_differ():
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = thue.translate({97: 98, 98: 97})
    assert set(ngram_jaccard.set_of(thue)).isdisjoint(ngram_jaccard.set_of(other))
    assert len(ngram_jaccard.set_of(thue + " " + other)) == 1
    words = ["".join(x) for n in range(1, 5) for x in __import__("itertools").product("abcd", repeat=n)]
    assert len({int(ngram_jaccard.set_of(w)[0]) for w in words}) == len(words)
