"""Names of a catalogue in texts, and near misses, against plain Python."""

from __future__ import annotations

import datetime as dt
import difflib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fixed_values as V
from sparkloom.functions import fuzzy, routing
from sparkloom.operators import gazetteer

NAMES = "kind string, surface string, canonical string"


def brute(texts, names):
    out = set()
    for kind in {n[0] for n in names}:
        table: dict[str, str] = {}
        for _, s, c in (n for n in names if n[0] == kind):
            table[s] = min(table.get(s, c), c)
        pattern = re.compile(r"\b(" + "|".join(re.escape(s) for s in sorted(table, key=len, reverse=True)) + r")\b")
        for key, text in texts:
            out |= {(key, kind, m[1], table[m[1]], m.start()) for m in pattern.finditer(text or "")}
    return out


def test_matches_equal_an_alternation(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", "c1", "é", "st"]
    phrase = lambda n, seps: "".join(w + rng.choice(seps) for w in rng.choices(words, k=n)) + rng.choice(words)
    names = [(rng.choice("xy"), phrase(rng.randrange(4), [" ", " ", "-", ". "]), f"n{i}") for i in range(60)]
    texts = [(i, rng.choice(["", "(", " "]) + phrase(rng.randrange(30), [" ", " ", "-", ". ", "  ", ", "]) + rng.choice(["", ".", " !"])) for i in range(200)] + [(900, None), (901, ""), (902, "...")]
    got = gazetteer.matches(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(names, NAMES), "key").collect()
    by_key = dict(texts)

    def start(text, at):
        parts = re.split(r"(?<=\W)(?=\w)", text)
        return len("".join(parts[:at]))

    assert {(r.key, r.kind, r.surface, r.canonical, start(by_key[r.key], r["at"])) for r in got} == brute(texts, names)
    assert len(got) == len(brute(texts, names))
    assert gazetteer.matches(spark.createDataFrame([], "key long, text string"), spark.createDataFrame(names, NAMES), "key").count() == 0
    assert gazetteer.matches(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([("x", "!?", "y"), ("x", "a.", "y")], NAMES), "key").count() == 0


def test_long_chain_of_overlapping_names(spark):
    texts = [(1, " ".join("ab"[i % 2] for i in range(4001)))]
    names = [("k", "a b", "1"), ("k", "b a", "2"), ("k", "a b a", "3")]
    got = gazetteer.matches(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(names, NAMES), "key").collect()
    assert Counter(r.canonical for r in got) == Counter(c for *_, c, _ in brute(texts, names))


def test_texts_are_read_once_and_only_likely_names_leave_their_task(spark):
    """Texts were read twice, and each of their words became two rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    words = " ".join(f"w{i}" for i in range(2000))
    texts = spark.createDataFrame([(i, f"{words} red bolt no. {i} {words}") for i in range(20)], "key long, text string").mapInArrow(counted, "key long, text string")
    names = [("parts", f"red bolt no. {i}", f"#{i}") for i in range(10)] + [("parts", "red bolt", "bolt")]
    got = gazetteer.matches(texts, spark.createDataFrame(names, NAMES), "key")
    assert sorted((r.key, r.canonical, r["at"], r.m) for r in got.collect()) == [(i, f"#{i}" if i < 10 else "bolt", 2000, 4 if i < 10 else 2) for i in range(20)]
    assert read.value == 20


def test_spots_of_lots_equal_those_of_single_texts(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "b", " ", "-", "\n", "é", "\U0001d54f", "_", "7", "😀"], k=rng.randrange(40))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], names=["key", "text"])
    spots = lambda: [tuple(r.values()) for b in gazetteer._spots([1, 2, 4], lambda h: h >= 0)([batch]) for r in b.to_pylist()]
    want = set()
    for key, x in enumerate(texts):
        found = list(re.finditer(r"\w+", x))
        ahead = int(bool(found) and found[0].start() > 0)
        want |= {(key, i + ahead, m, x[found[i].start() : found[i + m - 1].end()]) for m in (1, 2, 4) for i in range(len(found) - m + 1)}
    whole = spots()
    assert len(whole) == len(want) and set(whole) == want
    monkeypatch.setattr(gazetteer, "LOT", 50)
    assert sorted(spots()) == sorted(whole)


def test_catalogue_equals_the_small_lists(spark):
    names = [(kind, s, c) for kind, table in routing.LEXICON.items() for s, c in table.items()]
    rng = random.Random(1)
    surfaces = [s for _, s, _ in names]
    rows = [(i, " and ".join(rng.choices([*surfaces, "the", "patient's", "no"], k=rng.randrange(6)))) for i in range(150)]
    q = spark.createDataFrame(rows, "qid long, q string")
    plain = q.withColumn("e", routing.entities(F.col("q"), F.col("q"), dt.date(2026, 10, 1)))
    empty = plain.withColumn("e", F.struct(*[F.array().cast("array<string>").alias(k) for k in ("drugs", "labs", "conditions")]))
    more = {r.qid: r.e for r in gazetteer.with_catalogue(empty, spark.createDataFrame(names, NAMES)).collect()}
    both = F.array_contains("e.labs", "systolic blood pressure") & F.col("q").contains("blood pressure") & ~F.col("q").contains("systolic")
    for r in plain.withColumn("both", both).collect():
        labs = [x for x in r.e.labs if not (r.both and x == "diastolic blood pressure" and x not in more[r.qid].labs)]
        assert (more[r.qid].drugs, more[r.qid].labs, more[r.qid].conditions) == (r.e.drugs, labs, r.e.conditions)


@pytest.mark.parametrize("cutoff", [0.7, 0.85, 0.88, 0.95])
def test_near_pairs_are_all_pairs(spark, cutoff):
    rng = random.Random(int(cutoff * 100))
    base = ["".join(rng.choices("abcde", k=rng.randrange(1, 14))) for _ in range(60)] + ["aaaaaaaaaa", "abababababab", "banana", "bananas", "a"]

    def bent(w):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice(["", "a", "e", "x"]) + w[i + rng.randrange(2) :]
        return w

    words, others = sorted({bent(w) for w in base for _ in range(3)}), sorted({bent(w) for w in base for _ in range(2)} | set(base))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = {(r.word, r.other): r.ratio for r in fuzzy.near_pairs(frame(words), frame(others), cutoff).collect()}
    exp = {}
    for w in filter(None, words):
        m = difflib.SequenceMatcher()
        m.set_seq2(w)
        for o in filter(None, others):
            m.set_seq1(o)
            if m.ratio() >= cutoff:
                exp[w, o] = m.ratio()
    assert got == exp and exp


def test_candidates_are_few_and_names_found_again(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("etaoinshrdlu", k=rng.randrange(8, 14))) for _ in range(2000)})
    typos = [(i, w[:3] + w[4:]) for i, w in enumerate(names[:300])]
    asked = spark.createDataFrame(typos, "k long, word string")
    frame = spark.createDataFrame([(x,) for x in names], "name string")
    met = fuzzy.candidates(asked.select("word").distinct(), frame.withColumnRenamed("name", "word"), 0.88).count()
    assert met < 5 * len(typos)
    got = {(r.k, r.name) for r in fuzzy.near_names(asked, frame, "k").collect()}
    assert {(k, names[k]) for k, _ in typos} == got
    assert fuzzy.near_names(asked.limit(0), frame, "k").count() == fuzzy.near_names(asked, frame.limit(0), "k").count() == 0
    assert V.DRUGS


def test_candidates_have_the_letters_in_common_that_the_cutoff_asks_for(spark):
    # Other letters at both ends are an edit distance of two, as the cutoff allows, but leave eight of ten letters in common where nine are needed. All else that begins or ends so is frequent.
    asked, others = ["kestrelano"], ["xestrelanu", "kenoko", "kekeno"]
    got = fuzzy.candidates(spark.createDataFrame([(x,) for x in asked], "word string"), spark.createDataFrame([(x,) for x in others], "word string"), 0.85).collect()
    assert got == []
