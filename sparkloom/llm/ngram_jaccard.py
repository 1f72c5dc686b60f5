"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Prefix filter under several global token orders. Under any order of all tokens, two sets x and y of
similarity t or more share a token among the first |x| - ceil(t|x|) + 1 tokens of x and the like of y.
The orders here put rare tokens first (document frequency, capped at ``COMMON``) and differ in how
they break ties. A pair is a candidate only if every order admits it. Pairs are never listed:
an order links each document to the least document of every prefix token, the connected sets
of these links hold every pair that the order admits, and the next order works inside them. In a group of more than
a block, sets similar to a pivot are linked with it and need no comparison among themselves. What is left is verified
block against block: pairs that share a prefix token under each order are counted exactly, with the tokens that occur in two documents or more.

Rows with equal sets form one node from the start; a group of copies is one node, however large.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their
own component; fewer than five words form one shingle; a repeated doc_id links like any other row
and its rows all answer; a null doc_id keeps its row, with a null component unless it is linked with
others; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved, spare
from .components import components

WIDTH, PERCENT = 5, 80
#: Document frequencies from here on count as one: such tokens are ordered by hash alone.
COMMON = 64
#: Documents and tokens sorted together before the shuffle, tokens dealt to one group after it, tokens of a group worked on at a time.
DOCS, LOT, TOKENS, SLICE = 1 << 15, 1_000_000, 2_000_000, 250_000
#: Documents and tokens in one block of verification.
BLOCK, BLOCK_TOKENS = 256, 200_000
#: Nodes, and sets with shared tokens, for one file of a table about them: small tables are written as few files.
NODES_FILE, SETS_FILE = 50_000, 5_000
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 16
#: The global token orders: rare tokens first, ties by the hash with this seed.
ORDERS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each word: the sum of a number for each byte and its place in the word, scattered by ``mix``, so no two words are
    alike by the algebra of a polynomial."""
    edge = np.diff(_BLANK[raw], prepend=True, append=True).nonzero()[0]
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    length = end - start
    inside = ~_BLANK[raw]
    first = np.cumsum(length) - length  # of each word among the bytes of all words
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    return mix(np.add.reduceat(mix(raw[inside] + (place.astype(np.uint64) << np.uint64(8)), 0x9E3779B97F4A7C15), first) + length.astype(np.uint64))


def set_of(text: str | None) -> np.ndarray:
    """The sorted shingle hashes of a text; long texts are hashed stretch by stretch, cut at blanks."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)  # bytes: only A-Z
    words, at, n = [], 0, len(raw)
    blank = _BLANK[raw]
    while at < n:
        end = at + STRETCH
        if end < n:
            end += int(blank[end:].argmax())
            end = end if blank[end] else n
        words.append(_word_hashes(raw[at:end]))
        at = end
    h = np.concatenate(words) if words else np.empty(0, dtype=np.uint64)
    if not len(h):
        return h
    k = min(WIDTH, len(h))
    m = len(h) - k + 1
    s = h[:m] * _ODD[0]
    for i in range(1, k):
        s += h[i : i + m] * _ODD[i]
    return np.unique(mix(s, k))


def node_of(tokens: np.ndarray, salt: int) -> tuple[int, int]:
    """The number of a set, and a second digest by which sets of one number would be told apart."""
    both = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=bytes([salt])).digest(), dtype=np.int64)
    return int(both[0]), int(both[1])


def _nodes(key: str, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, checks = [], [], []
            for t in batch.column(1):
                s = set_of(t.as_py())
                node, check = node_of(s, salt) if len(s) else (None, None)
                sizes.append(len(s))
                nodes.append(node)
                checks.append(check)
            made = [pa.array(x, pa.int64()) for x in (sizes, nodes, checks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, batch.column(2), batch.column(3)], names=[key, "n_shingles", "node", "checked", "t0", "t1"])

    return run


def _press(x: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()) if len(x) else b""


def _spread(pressed, kind) -> np.ndarray:
    import zstandard

    if not len(pressed):
        return np.empty(0, dtype=kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(pressed), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(tokens: np.ndarray) -> bytes:
    """Sorted tokens by their differences."""
    return _press(np.diff(tokens, prepend=np.uint64(0)))


def _unpack(packed) -> np.ndarray:
    return np.cumsum(_spread(packed, np.uint64), dtype=np.uint64)


PARTS = "part int, lot long, home boolean, tokens binary, owners binary, nodes binary, wholes binary, marks binary"
LOTS = "lot long, tokens binary, owners binary, freqs binary, nodes binary, wholes binary"
LISTS = "node long, n_shingles long, tokens binary, freqs binary"
_PARTS = pa.schema([("part", pa.int32()), ("lot", pa.int64()), ("home", pa.bool_()), *[(c, pa.binary()) for c in ("tokens", "owners", "nodes", "wholes", "marks")]])
_LOTS = pa.schema([("lot", pa.int64()), *[(c, pa.binary()) for c in ("tokens", "owners", "freqs", "nodes", "wholes")]])
_LISTS = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("tokens", pa.binary()), ("freqs", pa.binary())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _free(n, shared):
    """Prefix places of a set of n tokens that are left for its ``shared`` ones; those of it alone come first in every order."""
    return shared - -(-PERCENT * n // 100) + 1


def _range_of(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _column(batch: pa.RecordBatch, name: str, kind) -> list[np.ndarray]:
    """A binary column as arrays, without a copy."""
    return [np.frombuffer(x.as_buffer(), dtype=kind) if x.is_valid and len(x.as_buffer()) else np.empty(0, kind) for x in batch.column(name)]


def _parted(parts: int, salt: int):
    """Tokens with the documents that hold them, dealt out by token range, a row for each lot of documents and range that the lot has
    tokens of. Documents are numbered within their lot; what the numbers stand for stays in the lot's home row, which passes the
    ranges by. A token that is common in one lot is known to be common everywhere: it stays in the home row too, and a mark goes to its range."""

    def lot(number: int, sets: dict[int, np.ndarray]) -> Iterator[tuple]:
        nodes = np.fromiter(sets, dtype=np.int64, count=len(sets))
        wholes = np.array([len(s) for s in sets.values()], dtype=np.int32)
        tokens = np.concatenate(list(sets.values()))
        sets.clear()
        owners = np.repeat(np.arange(len(nodes), dtype=np.uint16), wholes)
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        del order
        starts = _starts(tokens)
        counts = np.diff(np.append(starts, len(tokens)))
        marks = tokens[starts[counts >= COMMON]]
        common = np.repeat(counts >= COMMON, counts)
        yield number % parts, number, True, _pack(tokens[common]), _press(owners[common]), _press(nodes), _press(wholes), b""
        tokens, owners = tokens[~common], owners[~common]
        of_token, of_mark = _range_of(tokens, parts), _range_of(marks, parts)
        for p in np.union1d(of_token, of_mark):
            i, j = np.searchsorted(of_token, [p, p + np.uint64(1)])
            a, b = np.searchsorted(of_mark, [p, p + np.uint64(1)])
            yield int(p), number, False, _pack(tokens[i:j]), _press(owners[i:j]), b"", b"", marks[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, sets, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for t in batch.column(0):
                s = set_of(t.as_py())
                if len(s):
                    held += len(s)
                    sets[node_of(s, salt)[0]] = s
                    if len(sets) >= DOCS or held >= LOT:
                        yield from _batches(lot(number, sets), _PARTS)
                        number, held = number + 1, 0
        if sets:
            yield from _batches(lot(number, sets), _PARTS)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One token range: for every token that two documents or more hold, who holds it, lot by lot, with its capped frequency.

    The tokens are held packed in their lots' order and counted slice by slice. Copies of a document in several lots count as
    several; any frequencies give a right order as long as all documents see the same."""
    lots, tokens, owners, marks = [], [], [], []
    for batch in batches:
        cols = [batch.column(c) for c in ("lot", "home", "tokens", "owners", "nodes", "wholes", "marks")]
        for lot, home, packed, own, nodes, wholes, mark in zip(*cols, strict=True):
            if home.as_py():
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], f.type) for x, f in zip((lot, packed, own, pa.scalar(b""), nodes, wholes), _LOTS, strict=True)], schema=_LOTS)
            else:
                lots.append(lot.as_py())
                tokens.append(_unpack(packed.as_buffer()))
                owners.append(_spread(own.as_buffer(), np.uint16))
                marks.append(np.frombuffer(mark.as_py(), dtype=np.uint64))
    held = [t for t in tokens if len(t)]
    if not held:
        return
    marks = np.unique(np.concatenate(marks))
    low, high = min(int(t[0]) for t in held), max(int(t[-1]) for t in held)
    runs = max(1, -(-sum(map(len, tokens)) // SLICE))
    done, found = [0] * len(tokens), [[] for _ in lots]
    for k in range(1, runs + 1):
        edge = np.uint64(low + (high - low) * k // runs)
        ends = [int(np.searchsorted(t, edge, side="right")) for t in tokens]
        some = np.concatenate([t[i:j] for t, i, j in zip(tokens, done, ends, strict=True)])
        order = np.argsort(some, kind="stable")
        starts = _starts(some[order])
        counts = np.diff(np.append(starts, len(some)))
        freq = np.minimum(counts, COMMON).astype(np.uint8)
        freq[np.isin(some[order[starts]], marks)] = COMMON
        freqs = np.empty(len(some), dtype=np.uint8)
        freqs[order] = np.repeat(freq, counts)
        at = 0
        for n, (i, j) in enumerate(zip(done, ends, strict=True)):
            f = freqs[at : at + j - i]
            at += j - i
            more = f >= 2
            if more.any():
                found[n].append((tokens[n][i:j][more], owners[n][i:j][more], f[more]))
        done = ends

    def rows() -> Iterator[tuple]:
        for lot, some in zip(lots, found, strict=True):
            if some:
                t, o, f = (np.concatenate(x) for x in zip(*some, strict=True))
                yield lot, _pack(t), _press(o), _press(f), b"", b""

    yield from _batches(rows(), _LOTS)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One lot, from its home row and all ranges: the shared tokens of each node, with their frequencies. Nodes whose prefix
    holds none of them have no candidates and end here."""
    tokens, owners, freqs, nodes, wholes = [], [], [], None, None
    for batch in batches:
        for packed, own, f, n, w in zip(*[batch.column(c) for c in ("tokens", "owners", "freqs", "nodes", "wholes")], strict=True):
            tokens.append(_unpack(packed.as_buffer()))
            owners.append(_spread(own.as_buffer(), np.uint16))
            if len(n.as_buffer()):
                nodes, wholes = _spread(n.as_buffer(), np.int64), _spread(w.as_buffer(), np.int32).astype(np.int64)
                freqs.append(np.full(len(tokens[-1]), COMMON, dtype=np.uint8))
            else:
                freqs.append(_spread(f.as_buffer(), np.uint8))
    tokens, owners, freqs = map(np.concatenate, (tokens, owners, freqs))
    order = np.lexsort((tokens, owners))
    tokens, owners, freqs = tokens[order], owners[order], freqs[order]
    starts = _starts(owners)
    stops = np.append(starts[1:], len(owners)) if len(owners) else starts
    who = owners[starts]
    able = _free(wholes[who], stops - starts) > 0

    def rows() -> Iterator[tuple]:
        for x, i, j in zip(who[able], starts[able], stops[able], strict=True):
            yield int(nodes[x]), int(wholes[x]), tokens[i:j].tobytes(), freqs[i:j].tobytes()

    yield from _batches(rows(), _LISTS, 512)


def shared_tokens(docs: DataFrame, text: str, total: int, salt: int) -> DataFrame:
    """Per node: the tokens that another document holds too, sorted, with their capped frequencies.

    ``docs`` should come from a table: a task that is run again must deal the same lots."""
    parts = max(1, min(1 << 24, -(-total // TOKENS)))
    dealt = docs.select(text).mapInArrow(_parted(parts, salt), PARTS)
    lists = dealt.groupBy("part").applyInArrow(_frequencies, LOTS).groupBy("lot").applyInArrow(_lists, LISTS)
    return lists.dropDuplicates(["node"])  # copies of a document in several lots


def prefix(tokens: np.ndarray, freqs: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The shared tokens in the prefix of a set of n tokens under the order (capped frequency, hash with this seed)."""
    free = _free(n, len(tokens))
    return tokens[np.lexsort((mix(tokens, seed), freqs))[:free]] if free > 0 else tokens[:0]


def _prefixes(seed: int):
    """Prefix tokens of each document under one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = zip(_column(batch, "tokens", np.uint64), _column(batch, "freqs", np.uint8), batch.column("n_shingles").to_pylist(), strict=True)
                found = [prefix(t, f, n, seed) for t, f, n in rows]
                lens = [len(x) for x in found]
                token = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(c), lens), pa.int64()) for c in ("node", "grp")), pa.array(token)], names=["node", "grp", "token"])

    return run


def _candidates(nodes: DataFrame, seed: int, parts: int) -> DataFrame:
    """Nodes with a group each: sets of nodes that hold every pair which this order, and those before, admit."""
    entries = nodes.select("node", "n_shingles", "tokens", "freqs", "grp").mapInArrow(_prefixes(seed), "node long, grp long, token long")
    least = entries.groupBy("grp", "token").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = entries.join(least, ["grp", "token"]).select(F.col("node").alias("a"), "b").where("a != b")
    found = components(edges, parts)
    return nodes.drop("grp").join(found.withColumnRenamed("root", "grp"), "node")


class Postings:
    """Token lists turned round: how many tokens each list shares with list x."""

    def __init__(self, lists: list[np.ndarray]):
        self.m, lens = len(lists), [len(x) for x in lists]
        self.at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        _, self.ids = np.unique(np.concatenate(lists), return_inverse=True)
        order = np.argsort(self.ids, kind="stable")
        self.by = np.repeat(np.arange(self.m, dtype=np.int32), lens)[order]
        self.starts = np.searchsorted(self.ids[order], np.arange(self.ids.max() + 2 if len(self.ids) else 1))

    def shared(self, x: int) -> np.ndarray:
        own = self.ids[self.at[x] : self.at[x + 1]]
        low = self.starts[own]
        width = self.starts[own + 1] - low
        flat = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum()) if len(own) else own
        return np.bincount(self.by[flat], minlength=self.m)


def _verified(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links of similarity PERCENT or more between two blocks (or inside one), as a forest. Pairs that share no prefix token
    under one of the orders are no candidates."""
    first, second = key[1].as_py(), key[2].as_py()
    batch = table.combine_chunks().to_batches()[0]
    m = batch.num_rows
    lists, freqs = _column(batch, "tokens", np.uint64), _column(batch, "freqs", np.uint8)
    sizes, blocks, names = (batch.column(c).to_numpy() for c in ("n_shingles", "block", "node"))
    filters = [Postings([prefix(t, f, n, seed) for t, f, n in zip(lists, freqs, sizes.tolist(), strict=True)]) for seed in ORDERS]
    whole = Postings(lists)
    parent = list(range(m))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x in range(m):
        if first != second and blocks[x] != first:
            continue
        ok = blocks == second if first != second else np.arange(m) > x
        for order in filters:
            ok &= order.shared(x) > 0
            if not ok.any():
                break
        else:
            both = whole.shared(x)
            ok &= 100 * both >= PERCENT * (sizes[x] + sizes - both)
            for y in np.flatnonzero(ok):
                p, q = root(x), root(int(y))
                if p != q:
                    parent[p] = q
                    links.append((int(names[x]), int(names[y])))
    return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


SETTLED = "node long, n_shingles long, tokens binary, freqs binary, grp long, kind int"


def _near_pivot(kind: int):
    """Sets of kind 0 that are similar to the pivot of their group get this kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, pivots = _column(batch, "tokens", np.uint64), _column(batch, "pivot", np.uint64)
            sizes, others, kinds = (batch.column(c).to_pylist() for c in ("n_shingles", "pivot_size", "kind"))
            for i, (x, p) in enumerate(zip(lists, pivots, strict=True)):
                if kinds[i] == 0:
                    both = len(np.intersect1d(x, p, assume_unique=True))
                    if 100 * both >= PERCENT * (sizes[i] + others[i] - both):
                        kinds[i] = kind
            cols = [batch.column(c) for c in ("node", "n_shingles", "tokens", "freqs", "grp")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds, pa.int32()), batch.column("pivot_node")], names=["node", "n_shingles", "tokens", "freqs", "grp", "kind", "pivot_node"])

    return run


def _weight() -> tuple:
    return F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("tokens") / 8).alias("volume")


def _settled(sets: DataFrame, parts: int, rounds: int = 2) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Groups of more than a block: those near a pivot are linked with it and need no comparison among themselves.

    Returns the sets with their ``kind`` (0: near no pivot), the links found, and the tables that these read."""
    sets, links, used = sets.withColumn("kind", F.lit(0)), [], []
    big = sets.groupBy("grp").agg(*_weight()).where((F.col("n") > BLOCK) | (F.col("volume") > BLOCK_TOKENS)).select("grp")
    big = saved(big.coalesce(parts), "large")  # far fewer than sets
    if big.isEmpty():
        return sets, links, used
    for kind in range(1, rounds + 1):
        chosen = F.max_by(F.struct("node", "n_shingles", "tokens"), F.struct(F.xxhash64("node"), "node"))
        pivots = sets.where("kind = 0").join(big, "grp", "left_semi").groupBy("grp").agg(chosen.alias("p"))
        pivots = pivots.select("grp", F.col("p.node").alias("pivot_node"), F.col("p.n_shingles").alias("pivot_size"), F.col("p.tokens").alias("pivot"))
        pivots = saved(pivots.coalesce(parts), "pivots")
        # A join of a hot group with its one pivot, which adaptive execution splits.
        told = sets.join(pivots, "grp").mapInArrow(_near_pivot(kind), f"{SETTLED}, pivot_node long")
        told = saved(told, "settled")
        used += [told, pivots]
        links.append(told.where(f"kind = {kind} and node != pivot_node").select(F.col("node").alias("a"), F.col("pivot_node").alias("b")))
        sets = sets.join(pivots.select("grp"), "grp", "left_anti").select(told.columns[:-1]).unionByName(told.drop("pivot_node"))
    sets = saved(sets, "kinds")
    return sets, links, [*used, big, sets]


def links(docs: DataFrame, text: str, total: int, salt: int) -> tuple[DataFrame, int, list[DataFrame]]:
    """Links between different sets that join every two similar ones, directly or by way of others; the files that tables about them need; and the
    tables that the links read, of no use once they are written."""
    lists = shared_tokens(docs, text, total, salt)
    sets = saved(lists.withColumn("grp", F.lit(0).cast("long")), "sets")
    parts = max(1, -(-sets.count() // SETS_FILE))
    for seed in ORDERS:
        fewer = saved(_candidates(sets, seed, parts).coalesce(parts), "candidates")
        forget(sets)
        sets = fewer
    used = [sets]
    sets, found, more = _settled(sets, parts)
    used += more
    sized = sets.groupBy("grp", "kind").agg(*_weight())
    count = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("volume") / BLOCK_TOKENS)).cast("long")
    kinds = sized.groupBy("grp").agg(F.collect_list(F.struct("kind", count.alias("blocks"))).alias("kinds"))  # three entries at most
    used.append(kinds := saved(kinds.coalesce(parts), "blocks"))  # of known size when the join is planned: no exchange of the sets where it is small
    code = lambda kind, block: F.shiftleft(kind.cast("long"), 40) + block
    own = F.filter("kinds", lambda k: k["kind"] == F.col("kind"))[0]["blocks"]
    # Blocks of one pivot's sets meet only blocks of other kinds.
    others = F.flatten(F.transform(
        F.filter("kinds", lambda k: (k["kind"] != F.col("kind")) | (F.col("kind") == 0)),
        lambda k: F.transform(F.sequence(F.lit(0).cast("long"), k["blocks"] - 1), lambda b: code(k["kind"], b)),
    ))
    blocked = (
        sets.join(kinds, "grp")
        .withColumn("block", code(F.col("kind"), F.pmod(F.xxhash64("node"), own)))
        .withColumn("other", F.explode(others))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .select("grp", "i", "j", "node", "block", "n_shingles", "tokens", "freqs")
        .repartition("grp", "i", "j")  # else a plan that has dealt by group already keeps all blocks of it in one task
    )
    checked = blocked.groupBy("grp", "i", "j").applyInArrow(_verified, "a long, b long")
    for more in found:
        checked = checked.unionByName(more)
    return checked, parts, used


def _digests(text: str) -> tuple:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _rooted(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their ``node`` and the digests of their text, and the nodes with their ``root``, least key and first row."""
    kind = docs.schema[key].dataType.simpleString()
    for salt in range(256):
        rows = saved(docs.select(key, text, *_digests(text)).mapInArrow(_nodes(key, salt), f"`{key}` {kind}, n_shingles long, node long, checked long, t0 long, t1 long"), "nodes")
        first = F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), "t0", "t1"))
        own = rows.where("node is not null").groupBy("node").agg(F.min(key).alias("low"), F.max("n_shingles").alias("n_shingles"), F.min("checked").alias("c0"), F.max("checked").alias("c1"), first.alias("first"))
        own = saved(own.coalesce(max(1, -(-rows.count() // NODES_FILE))), "own")
        if own.where("c0 != c1").isEmpty():
            break  # else two sets have one number; number them anew
    total = own.agg(F.sum("n_shingles")).first()[0]
    if total is None:
        return rows, own.select("node", F.col("node").alias("root"), "low", "first")
    linked, parts, used = links(docs, text, total, salt)
    found = components(linked, parts)
    forget(*used)
    return rows, own.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low", "first")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (the least key reachable by links) of every row."""
    rows, reach = _rooted(docs, key, text)
    own = reach.join(reach.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return rows.join(own, "node", "left").select(
        key, "n_shingles", F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id")
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each component stays: that with the least key (null is the greatest), of several texts
    under it that with the least digest, and of equal rows one. Rows are told apart by key and text, so unlike texts under one key all
    stay. Texts without words link with nothing: all their rows stay."""
    _, reach = _rooted(docs, key, text)
    k, t0, t1, nth = (spare(c, docs) for c in ("k", "t0", "t1", "nth"))
    chosen = reach.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias(k), F.col("first.t0").alias(t0), F.col("first.t1").alias(t1))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col(key).eqNullSafe(F.col(k)) & (_digests(text)[0] == F.col(t0)) & (_digests(text)[1] == F.col(t1))
    w = Window.partitionBy(key, t0, t1).orderBy(F.lit(0))
    met = docs.where(worded).join(chosen, same).withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1)
    return met.select(*docs.columns).unionByName(docs.where(~worded))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return join(table(spark, sf_dir, "documents"))
