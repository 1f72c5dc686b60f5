"""Byte-pair encoding and decoding with a deterministic automaton over tokens.

Compiling. The automaton starts with one state that loops on every base symbol. Each merge
(a, b) -> c, in order of rank, is one gadget: where an a-arc leads to a state with a b-arc, the
state is split into one that a reaches, which loses its b-arc, and the old one; and a c-arc runs
from before a to after b. Since every arc of one token leads to the same state, a state is named
by the token last read. The state after c is a copy of the state after b as it was when c was made, and a c-arc
was laid along the a-arcs when c was made; so a merge takes the arc t from the state after x if x
ended with its left part, and t began with its right part, when its turn came. Tokens that lose to the same
merges as states are one state, and likewise as arcs; what is left is the transition table, one bit for each pair of
classes (20 MB for 49 000 tokens). It is made once, on the driver, and broadcast; encoding only reads it.

A word has exactly one path of arcs that spells it; its tokens are the encoding. Decoding emits
the arc labels of the ids.

Defined results: null is encoded as the empty text (no ids); texts of any length are encoded
whole; repeated rows are encoded row by row; an empty table gives an empty table. Strings of
the added special tokens in a text become their ids, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose encoding a worker remembers at a time; more are encoded anew.
REMEMBERED = 120_000
#: Rows that are encoded before they are handed on.
ROWS = 512
#: Texts of only these characters are split here; the rest go through the library's own normaliser and splitter.
_OTHER = re.compile("[^\t\n\r -~¡-įı-ſ]")
_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼-¾]"
    r"|[^\sa-zA-ZªµºÀ-ÖØ-öø-ſ0-9²³¹¼-¾]+"
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class Automaton:
    """The compiled merges: arrays over tokens, one entry for each gadget."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix, n = suffix, max(vocab.values(), default=-1) + 1
        self.n = n
        left, right, born = [-1] * n, [-1] * n, [-1] * n
        live = [False] * n  # whether any arc carries the token
        cut: dict[int, int] = {}  # x * n + t -> rank of the merge that takes arc t from the state after x
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = {a + b for a, b in pairs}
        for token, i in vocab.items():
            live[i] = token not in made
        for rank, (a, b) in enumerate(pairs):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if born[c] >= 0:
                raise ValueError(f"two merges make the token {c}")
            if live[a] and live[b] and self._walk(a, b, rank, cut, born, left, right):
                left[c], right[c], born[c], live[c] = a, b, rank, True
                cut[a * n + b] = rank
        self.label = [""] * n
        for token, i in vocab.items():
            self.label[i] = token
        self._tabulate(cut, born, left, right)
        self._lay(vocab, live)

    def _walk(self, x: int, t: int, before: int, cut: dict, born: list, left: list, right: list) -> bool:
        """Whether the state after x has an arc t once all merges ranked under ``before`` are built in."""
        n = self.n
        while True:
            r = cut.get(x * n + t)
            if r is not None and r < before:
                return False
            bx, bt = born[x], born[t]
            if bx > bt:
                x, before = right[x], bx
            elif bt > bx:
                t, before = left[t], bt + 1  # (a, a): the state after a has lost its a-arc by then
            elif bx < 0:
                return True
            else:
                x, t, before = right[x], left[t], bx

    def _losses(self, cuts: dict[int, list[int]], born: list, inner: list, ahead: int) -> tuple[array, list[tuple[int, ...]]]:
        """Class of each token, and of each class the merges that it can lose to: those that have, as their part, the piece of the
        token that stood there when their turn came. ``ahead`` is 1 if the merge that made the next larger piece counts too."""
        number: dict[tuple[int, ...], int] = {}
        of = array("i", [0]) * self.n
        for x in range(self.n):
            lost, y, until = [], x, 1 << 40
            while y >= 0:
                lost += [r for r in cuts.get(y, ()) if born[y] < r < until]
                y, until = inner[y], born[y] + ahead
            of[x] = number.setdefault(tuple(sorted(lost)), len(number))
        return of, list(number)

    def _tabulate(self, cut: dict, born: list, left: list, right: list) -> None:
        """The transition table: ``table[row[x] + (column[t] >> 3)] >> (column[t] & 7) & 1`` is 1 if the state after x has an arc t."""
        as_left: dict[int, list[int]] = {}
        as_right: dict[int, list[int]] = {}
        for key, rank in cut.items():
            as_left.setdefault(key // self.n, []).append(rank)
            as_right.setdefault(key % self.n, []).append(rank)
        states, of_state = self._losses(as_left, born, right, 0)
        self.column, of_arc = self._losses(as_right, born, left, 1)
        losing: dict[int, list[int]] = {}
        for k, lost in enumerate(of_arc):
            for r in lost:
                losing.setdefault(r, []).append(k)
        arcs = {r: np.array(k) for r, k in losing.items()}
        width = -(-len(of_arc) // 8)
        table = np.empty((len(of_state), width), dtype=np.uint8)
        for k, lost in enumerate(of_state):
            there = np.ones(width * 8, dtype=np.uint8)
            for r in lost:
                there[arcs[r]] = 0
            table[k] = np.packbits(there, bitorder="little")
        self.table = table.tobytes()
        self.row = array("q", [k * width for k in states])

    def arc(self, x: int, t: int) -> bool:
        """Whether the state after x has an arc t; both are tokens that some arc carries."""
        c = self.column[t]
        return bool(self.table[self.row[x] + (c >> 3)] >> (c & 7) & 1)

    def _lay(self, vocab: dict[str, int], live: list[bool]) -> None:
        """The labels of live arcs as a transition table over bytes: next node, and the token that ends there."""
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.step: dict[int, int] = {}
        self.inner, self.final = array("i", [-1]), array("i", [-1])  # token inside a word, token that ends one
        for token, i in vocab.items():
            if not live[i]:
                continue
            last = bool(self.suffix) and token.endswith(self.suffix)
            node = 0
            for c in token.removesuffix(self.suffix) if last else token:
                key = node << 8 | back[c]
                if key not in self.step:
                    self.step[key] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.step[key]
            if last or not self.suffix:
                self.final[node] = i
            if not last:
                self.inner[node] = i

    def word(self, raw: bytes) -> list[int]:
        """The one path that spells the bytes of a word.

        Longest arcs are tried first. A prefix has one path at most, so a position from which no
        arc leads on is dead for good, and each position is left at most once.
        """
        n, step, inner, final, table, column = len(raw), self.step, self.inner, self.final, self.table, self.column
        path: list[int] = []
        ends = [0]
        dead, limit, row = 0, n, -1
        while ends[-1] < n:
            node, i, found = 0, ends[-1], []
            while i < limit:
                node = step.get(node << 8 | raw[i])
                if node is None:
                    break
                i += 1
                t = inner[node] if i < n else final[node]
                if t >= 0:
                    found.append((i, t))
            while found:
                end, t = found.pop()
                if not dead >> end & 1:
                    if row < 0:
                        break
                    c = column[t]
                    if table[row + (c >> 3)] >> (c & 7) & 1:
                        break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a base symbol")
                path.pop()
                end = ends.pop()
                dead |= 1 << end
                limit, row = end - 1, self.row[path[-1]] if path else -1
                continue
            path.append(t)
            ends.append(end)
            limit, row = n, self.row[t]
        return path


class Codec:
    """Encodes and decodes texts with one compiled vocabulary; lives in a worker."""

    def __init__(self, spec: dict):
        self.auto: Automaton = spec["automaton"]
        self.added: dict[str, int] = spec["added"]
        self.rules = spec["rules"]
        self.library = None
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.known: dict[str, tuple] = {}
        self.label = dict(enumerate(self.auto.label)) | {i: s for s, i in self.added.items()}
        self.parts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _words(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _SPLIT.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.rules)
        # Back from the byte alphabet, so that both ways hand on plain words.
        back = {c: b for b, c in self.alphabet.items()}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in split]

    def _learn(self, word: str) -> tuple:
        ids = self.auto.word(word.encode("utf-8"))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = (tuple(ids), " ".join(map(str, ids)))
        return found

    def _plain(self, text: str, ids: list[int], said: list[str]) -> None:
        get, learn = self.known.get, self._learn
        for w in self._words(text):
            e = get(w) or learn(w)
            ids += e[0]
            said.append(e[1])

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """The ids, and the ids in decimal joined by one space."""
        ids: list[int] = []
        said: list[str] = []
        text, at = text or "", 0
        if self.parts is not None:
            for m in self.parts.finditer(text):
                self._plain(text[at : m.start()], ids, said)
                ids.append(self.added[m[0]])
                said.append(str(ids[-1]))
                at = m.end()
        self._plain(text[at:] if at else text, ids, said)
        return ids, " ".join(said)

    def decode(self, ids: list[int]) -> str:
        """The arc labels joined by one space, as the library does for a vocabulary without a decoder."""
        return " ".join(map(self.label.__getitem__, ids))


def compile_file(path: str) -> dict:
    """Read a tokenizers file and compile it. Its size is that of the vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or spec.get("decoder"):
        raise ValueError("only plain byte-level BPE files without a decoder are supported")
    rules = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})
    return {
        "automaton": Automaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or ""),
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "rules": rules,
    }


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


#: Columns that apply() can give, with their Spark and Arrow types.
MADE = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}


def apply(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every text, and decode the ids again: ``key`` and the ``columns`` of MADE that are asked for.

    One pass, no shuffle; the compiled vocabulary is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    spec = spark.sparkContext.broadcast(compile_file(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch, rows = whole.slice(start, ROWS), []
                for t in batch.column(1):
                    ids, said = codec.encode(t.as_py())
                    back = codec.decode(ids)
                    row = {"n_tokens": len(ids), "ids_sha256": _sha(said), "decoded_sha256": _sha(back), "ids": np.array(ids, dtype=np.int32), "decoded": back}
                    rows.append([row[c] for c in columns])
                made = [pa.array(x, MADE[c][1]) for c, x in zip(columns, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[key, *columns])

    out = ", ".join(f"{c} {MADE[c][0]}" for c in columns)
    return docs.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, f"`{key}` {kind}, {out}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.base import spread
    from .common import table

    return apply(spread(table(spark, sf_dir, "documents")), default_vocabulary(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))
