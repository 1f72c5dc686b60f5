"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to further tokens.

Base spans come from one pattern for each kind. They are found, leftmost and without overlap, in time linear in the text
also where a plain search would start again at every character of a long run.

The random field. Its nodes are the words that hold a digit or ``@`` (all others are O by definition), its labels O and the
four kinds. A word is described by its shape, its checks (Luhn, octets) and a hash of the word before it. Words that stand next
to each other share a transition potential. Distant words that are equal after normalisation, or alike (the same last
seven digits, the same name before ``@``), share a potential that rewards equal labels; every word is linked with the first
of its key, so links grow with the words. A number of 14 digits or more that fails Luhn's check is no card, and four numbers of which
one is above 255 are no address: these labels have no weight there. Words in a base span are observed. Loopy sum-product message passing gives each other
word its beliefs, and words with a kind of belief ``LEAST`` or more become added spans; neighbours of one kind are joined while
they are short. So a number that a pattern missed because of what stands around it, or the part of a
number that is whole elsewhere in the document, is found; base spans always stay.

Weights are learned from the base spans of the table itself by pseudo-likelihood, on about ``DOCS`` documents chosen by hash, and of
these at most ``TOKENS`` words of each label with the smallest hash, weighted back to the shares they were drawn from. A text that many documents hold counts once. Every document is
read whole and judged by itself, where it stands; nothing is shuffled but the sample.

Defined results: a null or empty text has no spans; repeated rows are judged row by row and null ids pass through; other columns are
not read; an empty table gives an empty table; without any base span in the sample nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, saved

KINDS = ("email", "ip", "card", "phone")
#: Documents and words a label of the sample; hash values of the word before; rounds of messages; belief of an added span; words in one field.
DOCS, TOKENS, BEFORE, ROUNDS, LEAST, FIELD = 20_000, 4_000, 32, 20, 0.5, 20_000
LABELS = 1 + len(KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
CORE = re.compile(r"\+?[^\W_](?:.*[^\W_])?", re.S)
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    other = digits[-2::-2]
    return (sum(map(int, digits[-1::-2])) + sum(map(int, other.translate(DOUBLED)))) % 10 == 0


#: The sum of the digits of twice a digit.
DOUBLED = str.maketrans("0123456789", "0246813579")


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            last = m.end()
            yield begin, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 38:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- words as nodes ----------------------------------------------------------------------------
#: Feature numbers: 0 always, then one for each property below, then steps of digits and dots, then the hashed word before.
PROPERTIES, DIGIT_STEPS, DOT_STEPS = 11, (4, 7, 10, 14, 20), 4
DIGITS_AT = 1 + PROPERTIES
DOTS_AT = DIGITS_AT + len(DIGIT_STEPS) + 1
BEFORE_AT = DOTS_AT + DOT_STEPS + 1
FEATURES = BEFORE_AT + BEFORE + 1


def code(word: str) -> int:
    """A small stable hash of a word of at most 40 characters."""
    value = 0
    for b in word.encode():
        value = (value * 31 + b) % 1_000_003
    return value


def features(text: str, word_at: int, word: str, core: str, digits: str) -> list[int]:
    out = [0]
    plain = core.isascii() and not any(map(str.isalpha, core))
    octets = core.split(".")
    properties = (
        "@" in core, "@" in core and "." in core.rpartition("@")[2], core.startswith("+"), core.isdigit(), plain and "-" in core, not plain,
        len(core) >= 16 and not plain and not re.search("[^0-9a-fA-F]", core), "(" in word or ")" in word, 14 <= len(digits) <= 19 and plain and luhn(digits),
        len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets), "/" in core or ":" in core or "=" in core,
    )
    out += [1 + k for k, held in enumerate(properties) if held]
    out.append(DIGITS_AT + sum(len(digits) >= n for n in DIGIT_STEPS))
    out.append(DOTS_AT + min(core.count("."), DOT_STEPS))
    before = text[max(0, word_at - 40) : word_at].split()
    cue = "".join(filter(str.isalpha, before[-1])).lower() if before else ""
    out.append(BEFORE_AT + (1 + code(cue) % BEFORE if cue else 0))
    return out


def barred(core: str, digits: str) -> int:
    """The label that the word's checks rule out, or 0."""
    octets = core.split(".")
    if len(octets) == 4 and all(o.isascii() and o.isdigit() for o in octets):
        return 2 if any(len(o.lstrip("0")) > 3 or int(o.lstrip("0") or "0") > 255 for o in octets) else 0
    return 3 if len(digits) >= 14 and not (len(digits) <= 19 and luhn(digits)) else 0


def keys(core: str, digits: str) -> tuple[str | None, str | None]:
    """What equal words share, and what words that are alike share."""
    if len(core) < 7:
        return None, None
    low = core.lower()
    if "@" in core:
        return low, "n" + low.partition("@")[0]
    if any(map(str.isalpha, core)):
        return low, "n" + low
    return (low, None) if "." in core and len(digits) < 13 else (digits, "d" + digits[-7:] if len(digits) >= 7 else None)


class Field:
    """The random fields of some documents: nodes, links between neighbours, links between equal and between alike words."""

    def __init__(self):
        self.spots, self.feats, self.label, self.docs, self.barred = [], [], [], [], []
        self.next: list[int] = []
        self.links: tuple[list, list] = ([], [])

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last, first, k = -1, ({}, {}), 0
        spans = sorted(base, key=lambda s: s[0])
        longest = max((e - s for s, _, e in spans), default=0)
        for m in WORD.finditer(text):
            c = CORE.search(m[0])
            if not c:
                continue
            begin, end, core = m.start() + c.start(), m.start() + c.end(), c[0]
            digits = NOT_DIGIT.sub("", core)
            while k < len(spans) and spans[k][0] + longest <= begin:
                k += 1
            label = next((kind + 1 for s, kind, e in self._from(spans, k, end) if e > begin), 0)
            node = len(self.spots)
            self.next.append(last >= 0 and not text[last : m.start()].strip(BLANKS))
            last = m.end()
            self.spots.append((begin, end, len(digits)))
            self.feats.append(features(text, m.start(), m[0], core, digits))
            self.label.append(label)
            self.barred.append(0 if label else barred(core, digits))
            self.docs.append(doc)
            for key, seen, links in zip(keys(core, digits), first, self.links, strict=True):
                if key is not None and seen.setdefault(key, node) != node:
                    links.append((seen[key], node))

    @staticmethod
    def _from(spans, k: int, end: int):
        while k < len(spans) and spans[k][0] < end:
            yield spans[k]
            k += 1

    def __len__(self) -> int:
        return len(self.spots)

    def arrays(self):
        """Features as a 0/1 matrix, and (links, 2) arrays: neighbours, equal, alike but not equal."""
        x = np.zeros((len(self), FEATURES), dtype=np.float32)
        at = np.repeat(np.arange(len(self)), [len(f) for f in self.feats])
        x[at, np.fromiter((k for f in self.feats for k in f), np.int64)] = 1
        node = np.flatnonzero(self.next)
        equal = np.array(self.links[0], dtype=np.int64).reshape(-1, 2)
        same = set(self.links[0])
        alike = np.array([p for p in self.links[1] if p not in same], dtype=np.int64).reshape(-1, 2)
        return x, np.stack([node - 1, node], 1), equal, alike


# --- learning ----------------------------------------------------------------------------------
class Weights:
    def __init__(self):
        self.node, self.step = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS))
        self.link = np.zeros((2, LABELS))  # equal, alike


def fit(rows: list[tuple], counts: dict[int, int], rounds: int = 300, penalty: float = 1e-3) -> Weights:
    """Maximum pseudo-likelihood of sampled words: (label, features, label before, label after, equal words by label, alike words by label)."""
    w = Weights()
    if not rows:
        return w
    y = np.array([r[0] for r in rows])
    drawn = np.bincount(y, minlength=LABELS)
    share = np.array([counts.get(k, 0) / drawn[k] if drawn[k] else 0.0 for k in range(LABELS)])
    mass = share[y] / share[y].sum()
    x = np.zeros((len(rows), FEATURES))
    for k, r in enumerate(rows):
        x[k, r[1]] = 1
    left, right = np.eye(LABELS)[[r[2] for r in rows]], np.eye(LABELS)[[r[3] for r in rows]]
    equal, alike = (np.minimum(np.array([r[c] for r in rows], dtype=float), 3) for c in (4, 5))
    parts = [w.node, w.step, w.link]
    speed, ahead = [np.zeros_like(p) for p in parts], [p.copy() for p in parts]
    truth = np.eye(LABELS)[y]
    for k in range(rounds):  # gradient ascent with Nesterov's momentum
        node, step, link = ahead
        score = x @ node + left @ step + right @ step.T + equal * link[0] + alike * link[1]
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        gap = (truth - p / p.sum(1, keepdims=True)) * mass[:, None]
        grads = [x.T @ gap, left.T @ gap + gap.T @ right, np.stack([(equal * gap).sum(0), (alike * gap).sum(0)])]
        for p, v, a, g in zip(parts, speed, ahead, grads, strict=True):
            new = a + 1.0 * (g - penalty * a)
            if p is w.link:
                new = np.maximum(new, 0.0)  # links reward agreement
            v[:] = new - p
            p[:] = new
            a[:] = new + k / (k + 3) * v
    return w


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["label", "h", "feats", "before", "after", "equal", "alike"]
    ints = pa.list_(pa.int32())
    for batch in batches:
        field = Field()
        for k, t in enumerate(batch.column(1)):
            text = t.as_py() or ""
            if MARK.search(text):
                field.add(k, text, base_spans(text))
        n = len(field)
        label = field.label
        before = [label[i - 1] if field.next[i] else 0 for i in range(n)]
        after = [label[i + 1] if i + 1 < n and field.next[i + 1] else 0 for i in range(n)]
        near = []
        same = set(field.links[0])
        for links in (field.links[0], [p for p in field.links[1] if p not in same]):
            seen = [[0] * LABELS for _ in range(n)]
            for a, b in links:
                seen[a][label[b]] += 1
                seen[b][label[a]] += 1
            near.append(seen)
        salt = batch.column(0).to_pylist()
        h = [(salt[d] * 1_000_003 + s * 7_919) * 2_654_435_761 % (1 << 61) for d, (s, _, _) in zip(field.docs, field.spots, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(h, pa.int64()), pa.array(field.feats, ints), pa.array(before, pa.int32()), pa.array(after, pa.int32()), *(pa.array(s, ints) for s in near)], names=names)


def learn(docs: DataFrame, text: str = "text", sample: int = DOCS, tokens: int = TOKENS) -> Weights:
    """Weights from a sample of ``docs``, whose size two parameters bound."""
    hashed = docs.select(F.xxhash64(text).alias("salt"), F.col(text).alias("text"))
    every = max(1, docs.count() // sample)
    words = hashed.where(F.pmod(F.xxhash64("salt"), F.lit(every)) == 0).mapInArrow(_sampled, "label int, h long, feats array<int>, before int, after int, equal array<int>, alike array<int>")
    words = saved(words.dropDuplicates(["h"]), "words")  # a text that very many documents hold counts once
    counts = {r.label: r.n for r in words.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = ("h", "feats", "before", "after", "equal", "alike")
    rows = [tuple(r) for k in sorted(counts) for r in words.where(F.col("label") == k).orderBy(*order).limit(tokens).select("label", "feats", "before", "after", "equal", "alike").collect()]
    return fit(rows, counts)


# --- inference ---------------------------------------------------------------------------------
def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def beliefs(field: Field, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of every node after loopy sum-product with damping. The number of rounds is fixed, so a document's result does not depend on its batch."""
    x, chain, equal, alike = field.arrays()
    n = len(field)
    unary = x.astype(np.float64) @ w.node
    has_before = np.array(field.next, dtype=bool)
    has_after = np.append(has_before[1:], False)
    unary[~has_before] += w.step[0]
    unary[~has_after] += w.step[:, 0]
    ruled_out = np.flatnonzero(field.barred)
    unary[ruled_out, np.array(field.barred)[ruled_out]] -= 1e4
    seen = np.flatnonzero(field.label)
    unary[seen] -= 1e4
    unary[seen, np.array(field.label)[seen]] += 1e4
    tables = np.stack([w.step, np.diag(w.link[0]), np.diag(w.link[1]), w.step.T])
    source = np.concatenate([chain[:, 0], equal[:, 0], alike[:, 0], chain[:, 1], equal[:, 1], alike[:, 1]])
    target = np.concatenate([chain[:, 1], equal[:, 1], alike[:, 1], chain[:, 0], equal[:, 0], alike[:, 0]])
    sizes = [len(chain), len(equal), len(alike)]
    kind = np.repeat([0, 1, 2, 3, 1, 2], sizes * 2)
    half = sum(sizes)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    message = np.zeros((2 * half, LABELS))
    if half:
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, message)
            fresh = np.empty_like(message)
            for k in range(0, 2 * half, 50_000):
                part = slice(k, k + 50_000)
                fresh[part] = _lse((belief[source[part]] - message[back[part]])[:, :, None] + tables[kind[part]], 1)
            fresh -= fresh.max(1, keepdims=True)
            message = 0.5 * message + 0.5 * fresh
    belief = unary
    np.add.at(belief, target, message)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


def added_spans(field: Field, w: Weights) -> dict[int, list[tuple[int, int, int]]]:
    """Per document the spans of words that are in no base span and whose belief in a kind is ``LEAST`` or more."""
    p = beliefs(field, w)
    label = np.where(p[:, 1:].max(1) >= LEAST, p[:, 1:].argmax(1) + 1, 0)
    out: dict[int, list] = {}
    last = None  # (node, digits of the span so far) of the span that is being made
    for i in np.flatnonzero((label > 0) & (np.array(field.label) == 0)):
        i = int(i)
        begin, end, digits = field.spots[i]
        kind = int(label[i]) - 1
        spans = out.setdefault(field.docs[i], [])
        limit = {2: 19, 3: 15}.get(kind, 0)
        if last and last[0] == i - 1 and field.next[i] and spans[-1][1] == kind and last[1] + digits <= limit:
            spans[-1] = (spans[-1][0], kind, end)
            last = (i, last[1] + digits)
        else:
            spans.append((begin, kind, end))
            last = (i, digits)
    return out


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def _found(key: str, w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list] = []
            more: dict[int, list] = {}
            field = Field()
            for k, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                base.append(base_spans(text) if MARK.search(text) else [])
                if MARK.search(text):
                    field.add(k, text, base[-1])
                if len(field) > FIELD or k == batch.num_rows - 1:
                    if len(field):
                        more |= added_spans(field, w)
                        field = Field()
            kinds = [[kind for _, kind, _ in spans] for spans in base]
            columns = [pa.array([x.count(k) for x in kinds], pa.int64()) for k in range(len(KINDS))]
            whole = [named(sorted(spans + more[k])) if k in more else named(spans) for k, spans in enumerate(base)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(map(named, base), pa.string()), pa.array(whole, pa.string())], names=[key, "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """``key``, the number of base spans of each kind, ``base`` and ``spans`` (``kind:start:end``, joined by commas). Without ``weights`` they are learned from ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    w = learn(docs, text) if weights is None else weights
    return docs.select(key, text).mapInArrow(_found(key, w), f"`{key}` {kind}, {SCHEMA}")


def query(spark, sf_dir: str) -> DataFrame:
    from ..plans.base import spread
    from .common import table

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
