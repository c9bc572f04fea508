"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints link at up to two differing bits. By the pigeonhole principle a linked pair agrees on at
least two of four 16-bit blocks, so six tables, each keyed by one pair of blocks, hold every
pair in some group of equal keys. Groups of more than ``HOT_GROUP`` fingerprints are split the
same way once more by the four bytes of the other two blocks; what is left of them has at most
2^16 different fingerprints, whatever the data. Within a group fingerprints are sorted by
Gray rank and indexed by a tree whose nodes hold the bits that all below share.

``keep_one`` links by a wider rule, five-word shingles of similarity 0.8 or more: texts that share one of a
fifth of their shingles are candidates, 256 bits of parities (long texts: fingerprints) in the same index leave out the
far ones, and the shingles themselves decide. In large groups texts that are near many others are compared first, so that
what they join needs no pairs.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.llm.common import arrow_map, checkpointed, drop_folder, shared_dir, small_batches, written
from tremorlake.llm.substrings import rolling

MAX_BITS = 2
SHINGLE = 3
#: Groups of equal keys beyond this size are split by a second pair of blocks.
HOT_GROUP = 4096
#: Children of a node of the index.
FANOUT = 8
#: Members of a large group that are compared with all others first.
PIVOTS = 32
#: Search entries handled at once in a task.
FRONTIER = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, from the highest, the number of hashes that have it."""
    raw = hashes.byteswap().view(np.uint8).reshape(-1, 8)
    if len(raw) < 256:
        return np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return np.concatenate([np.bincount(raw[:, k], minlength=256) @ table for k in range(8)])


def fingerprint(text: str | None, hash64) -> int:
    """Bits set in over half of the hashes of the word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        shingles = [flat]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[:-1]]
        shingles = [flat[a:b] for a, b in zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    h = np.fromiter((hash64(s, 42) for s in shingles), np.uint64, n)
    bits = 2 * bit_counts(h) > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id and ``fp``, the fingerprint as a signed long."""
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def make():
        from xxhash import xxh64_intdigest

        def f(id, text):
            fps = np.array([fingerprint(t, xxh64_intdigest) for t in text], np.uint64)
            return {id_col: id, "fp": fps.view(np.int64)}

        return f

    return arrow_map(src, f"`{id_col}` {kind}, fp long", make)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the binary-reflected Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Index over fingerprints in groups, each of one or more 64-bit words: ``group`` numbers the groups from 0 and
    is sorted, and within a group ``fp`` (rows of words) is sorted by Gray rank. Level 0 is the fingerprints; a node of a level stands for up
    to ``FANOUT`` neighbours of the level below in one group, until each group has one root. A node
    keeps the pattern of the bits that all below share and its parent does not have, under a mask."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        fp = fp.reshape(len(fp), -1)
        both, any_, owner = fp, fp, group
        level = [(both, any_, np.arange(len(fp)))]
        self.first: list[np.ndarray] = []  # of each node, its first child in the level below
        owners = [owner]
        while len(owner) and (owner[1:] == owner[:-1]).any():
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[begin, len(owner)])
            inside = np.arange(len(owner)) - np.repeat(begin, size)
            cut = np.flatnonzero(inside % FANOUT == 0)
            both, any_ = np.bitwise_and.reduceat(both, cut, axis=0), np.bitwise_or.reduceat(any_, cut, axis=0)
            owner = owner[cut]
            level.append((both, any_, cut))
            self.first.append(np.r_[cut, len(owners[-1])])
            owners.append(owner)
        self.fp, self.group = fp, group
        # top down: the mask of a node's own bits leaves out those that its parent has settled
        self.pattern, self.mask = [None] * len(level), [None] * len(level)
        above = np.zeros(level[-1][0].shape, np.uint64)
        for k in range(len(level) - 1, -1, -1):
            both, any_, _ = level[k]
            shared = ~(both ^ any_)
            if k < len(level) - 1:
                above = np.repeat(above_mask, np.diff(self.first[k]), axis=0)
            self.pattern[k], self.mask[k] = both, shared & ~above
            above_mask = shared

    def pairs(self, limit: int | np.ndarray = MAX_BITS, joined: np.ndarray | None = None):
        """Yield arrays (i, j), i < j, of fingerprints of one group at up to ``limit`` differing bits, or up to
        ``limit[i]``. With ``joined``, numbers of classes that are known, pairs within a class are left out and nodes of one class
        are not entered for its own members."""
        top = len(self.pattern) - 1
        if not top:
            return
        self.least, self.most = [joined], [joined]
        for cut in self.first if joined is not None else ():
            self.least.append(np.minimum.reduceat(self.least[-1], cut[:-1]))
            self.most.append(np.maximum.reduceat(self.most[-1], cut[:-1]))
        root = np.searchsorted(self.group, self.group)  # numbers of groups ascend, so roots do too
        root = np.unique(root, return_inverse=True)[1]
        self.frontier = max(FANOUT, FRONTIER // self.fp.shape[1])
        limit = np.broadcast_to(limit, len(self.fp))
        step = max(1, self.frontier // (FANOUT * 16))
        for at in range(0, len(self.fp), step):
            query = np.arange(at, min(at + step, len(self.fp)))
            yield from self._search(query, root[query], np.zeros(len(query), np.uint16), top, limit)

    def _search(self, query, node, spent, k, limit):
        if self.least[0] is not None:
            own = self.least[0][query]
            open_ = (self.least[k][node] != own) | (self.most[k][node] != own)
            query, node, spent = query[open_], node[open_], spent[open_]
        spent = spent + np.bitwise_count((self.fp[query] ^ self.pattern[k][node]) & self.mask[k][node]).sum(axis=1, dtype=np.uint16)
        ok = spent <= limit[query]
        query, node, spent = query[ok], node[ok], spent[ok]
        if k == 0:
            ok = query < node
            if ok.any():
                yield query[ok], node[ok]
            return
        part = self.frontier // FANOUT
        for at in range(0, len(query), part):
            q, n, s = (x[at : at + part] for x in (query, node, spent))
            begin, size = self.first[k - 1][n], self.first[k - 1][n + 1] - self.first[k - 1][n]
            child = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            yield from self._search(np.repeat(q, size), child, np.repeat(s, size), k - 1, limit)


def group_links(group: np.ndarray, fp: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the index joins in each group, as places: each fingerprint that has a link, with the
    first of its class in the group; a class of n gives n - 1 links. ``fp`` has a row of words for each.

    In large groups some members are first compared with all others, so that one large class is known
    before the index is searched, and its inner pairs are not."""
    order = np.lexsort((*fp[:, :0:-1].T, gray_rank(fp[:, 0]), group))
    group, fp = group[order], fp[order]
    parent = np.arange(len(fp))
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(begin.tolist(), np.r_[begin[1:], len(fp)].tolist(), strict=True):
        for _ in range(PIVOTS if b - a > 4 * PIVOTS else 0):
            alone = np.flatnonzero(parent[a:b] == np.arange(a, b))
            alone = alone[alone > 0] if parent[a] == a and (parent[a:b] == a).sum() > 1 else alone
            if not len(alone):
                break
            pivot = a + int(alone[len(alone) // 2])
            near = a + np.flatnonzero(np.bitwise_count(fp[a:b] ^ fp[pivot]).sum(axis=1) <= limit)
            _join(parent, np.full(len(near), pivot), near)
    joined = _roots(parent, np.arange(len(fp)))
    for i, j in GrayIndex(group, fp).pairs(limit, joined):
        _join(parent, i, j)
    root = _roots(parent, np.arange(len(fp)))
    moved = root != np.arange(len(fp))
    return order[moved], order[root[moved]]


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins roots until every link (i, j) lies within a tree."""
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


def _key(fp, blocks, width):
    """SQL of the bits of ``blocks`` (numbers of fields of ``width`` bits, from the lowest)."""
    return " | ".join(f"(shiftrightunsigned({fp}, {b * width}) & {(1 << width) - 1}L) << {k * width}" for k, b in enumerate(blocks))


_PAIRS = list(combinations(range(4), 2))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among the different fingerprints ``fps.fp``, enough to join every pair at up to
    ``MAX_BITS`` differing bits; both ends are fingerprints, and a group of n gives at most n - 1."""
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).cast("int").alias("t"), F.expr(_key("fp", p, 16)).alias("k")) for t, p in enumerate(_PAIRS)))).alias("x")).select("fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["t", "k"])
    # a hot group's other two blocks are four bytes, of which a linked pair shares at least two
    rest = {t: [b for b in range(4) if b not in p] for t, p in enumerate(_PAIRS)}
    inner = F.expr("CASE t " + " ".join(f"WHEN {t} THEN {_key('fp', r, 16)}" for t, r in rest.items()) + " END")
    cuts = F.array(*(F.struct(F.lit(i).cast("int").alias("u"), F.expr(_key("inner", p, 8)).alias("v")) for i, p in enumerate(_PAIRS)))
    whole = F.array(F.struct(F.lit(-1).cast("int").alias("u"), F.lit(0).cast("long").alias("v")))
    shared = shared.withColumn("inner", inner).withColumn("y", F.explode(F.when(F.col("n") > HOT_GROUP, cuts).otherwise(whole))).select("fp", "t", "k", "y.u", "y.v")
    return _dealt_links(shared, ["t", "k", "u", "v"], ["fp"], MAX_BITS)


def _dealt_links(rows: DataFrame, keys: list[str], words: list[str], limit: int) -> DataFrame:
    """Links (a, b) of rows of equal ``keys`` whose fingerprints ``words`` differ in up to ``limit`` bits; ends are told by
    the fingerprint's first word."""

    def search(group, cols):
        yield group_links(group, np.stack([cols[w].view(np.uint64) for w in words], axis=1), limit)

    return _dealt(rows.select(*words, *keys), keys, words[0], search).distinct()


def _dealt(rows: DataFrame, keys: list[str], node: str, search, hold: int = 4 * FRONTIER) -> DataFrame:
    """Pairs (a, b) of ``node`` of rows of equal ``keys``, at the places that ``search`` yields from numbers of groups and columns."""
    # a task's rows of one group lie together; several groups share a task and one index
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    names = dealt.columns
    key_at = [names.index(k) for k in keys]

    def run(batches):
        def flush(part):
            t = pa.Table.from_batches(part)
            cols = {c: t.column(c).to_numpy() for c in names}
            new = np.zeros(len(t), bool)
            for k in keys:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            for a, b in search(np.cumsum(new), cols):
                yield pa.RecordBatch.from_pydict({"a": cols[node][a], "b": cols[node][b]})

        held, n = [], 0
        for batch in batches:
            if n >= hold and held:
                # all up to the last group's first row can go
                cols = [np.asarray(batch.column(i)) for i in key_at]
                last = [held[-1].column(i)[-1].as_py() for i in key_at]
                same = np.logical_and.reduce([c == x for c, x in zip(cols, last, strict=True)])
                k = int(np.argmin(same)) if not same.all() else len(same)
                if k < len(same):
                    yield from flush([*held, batch.slice(0, k)])
                    held, n, batch = [], 0, batch.slice(k)
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from flush(held)

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): every end ``v`` with ``root``, the smallest in its component.

    Large-star and small-star rounds, each a grouping by node, until the links no longer change; each
    round is checkpointed, and no component is gathered in one place. A node with very many links
    is split by the sort-based window over its rows, which spills."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    before = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour or itself
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: every smaller neighbour of a node, and the node, are linked to its smallest
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        e = checkpointed(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest
    id that links of up to two differing bits reach, its own included.

    Rows of equal fingerprints are one node, so copies cost one row each and no pairs. A null or
    blank text has fingerprint zero and links like any other. A null id counts as no id: its row
    gets the smallest other id of its component, or null. Repeated rows give repeated rows, an
    empty table none. Only the two named columns are read.
    """
    fps = checkpointed(fingerprints(df, id_col, text_col))
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(nodes.select("fp")))
    # the smallest id of a component is a minimum over its nodes, gathered by partial aggregation
    rooted = nodes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle of ``keep_one``. Texts link where of all their different shingles together at least four fifths are
#: in both; of n shingles then at least 4n/5 are shared, so that any n/5 + 1, rounded down, hold a shared one.
NEAR_SHINGLE = 5
#: 64-bit words of a fingerprint of ``keep_one``, and the bits beyond which two are not compared by their shingles. A bit
#: differs with a chance of 0.15 at a similarity of 0.8, and of 3/16 at most, for four shingles and one more: 103 of
#: 256 bits and more then have a chance of less than 10^-14.
NEAR_WORDS, NEAR_BITS = 4, 102
#: Texts of up to this many different shingles are held against one another by parities, texts of four fifths of it and more
#: by fingerprints, so that each pair of like sizes meets in one of the two. Parities leave out more up to about this size.
PARITY_SHINGLES = 450
#: Members of a large group by which its pivots are chosen, and the most times that pivots are.
SAMPLE, ROUNDS = 128, 3
#: The most shingles that are ordered by their count, and the count from which they are.
LISTED, OFTEN = 1 << 18, 16
#: Candidate keys that a task gets, about, and rows of candidates that a task gathers at once.
DEALT, HELD = 1 << 18, 1 << 17
#: Texts that a task compares, about.
COMPARED = 1 << 10
#: Texts whose bits are added up at once.
TEXTS = 16
#: Rows to drop, or to compare, are broadcast up to this many.
BROADCAST_ROWS = 2_000_000


def shingle_sets(texts: list[str | None], shingle: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """For each text the ascending hashes of its different shingles; fewer words are one shingle, no words none."""
    split = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}
    size = [len(w) for w in split]
    hashes = np.fromiter((known.get(w) or known.setdefault(w, xxh64_intdigest(w, 42)) for x in split for w in x), np.uint64, sum(size))
    ends = np.cumsum(size)
    return [np.unique(rolling(hashes[b - n : b], min(n, shingle))) if n else hashes[:0] for n, b in zip(size, ends.tolist(), strict=True)]


def wide_fingerprints(sets: list[np.ndarray], words: int = NEAR_WORDS) -> np.ndarray:
    """For each set of hashes ``words`` words of bits that are set in over half of them; zero for an empty set."""
    size = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), words), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    gram, n = np.concatenate(sets), size[some]
    start = np.cumsum(n) - n
    for k in range(words):
        h = gram * np.uint64(0x9E3779B97F4A7C15 + 2 * k) ^ np.uint64(k)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        for a in range(0, len(some), TEXTS):
            lo, hi = start[a], start[a + TEXTS] if a + TEXTS < len(start) else len(gram)
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1)
            counts = np.add.reduceat(bits, start[a : a + TEXTS] - lo, axis=0, dtype=np.int32)
            out[some[a : a + TEXTS], k] = np.packbits(2 * counts > n[a : a + TEXTS, None], axis=1).view(np.uint64).ravel()
    return out


def parities(sets: list[np.ndarray], words: int = NEAR_WORDS) -> np.ndarray:
    """For each set of hashes ``words`` words of bits, each the parity of how many of the set fall to it. What two sets
    share changes no differing bit, so these are never more than the hashes that one set has alone."""
    n = 64 * words
    place = np.concatenate([np.zeros(0, np.uint64), *sets]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = np.bincount(row * n + (place % np.uint64(n)).astype(np.int64), minlength=len(sets) * n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(sets), words)


def _near(x: dict, i, j) -> np.ndarray:
    """Whether candidates at the places i and j of columns may have a similarity of 0.8: by size, and by the bits of parities
    or fingerprints. Of sets of a and b hashes at 0.8 or more at most (a + b) / 9 are in one only."""
    a, b = x["n"][i], x["n"][j]
    bits = np.bitwise_count(x["fp"][i] ^ x["fp"][j]).sum(axis=-1, dtype=np.int64)
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & np.where(x["kind"][i] == 0, 9 * bits <= a + b, bits <= NEAR_BITS)


def _columns(cols: dict) -> dict:
    return {"n": cols["n"], "kind": cols["kind"], "class": cols["class"], "fp": np.stack([cols[f"w{k}"].view(np.uint64) for k in range(NEAR_WORDS)], axis=1)}


def pivot_pairs(group: np.ndarray, cols: dict):
    """Yield arrays (i, j): in large groups up to ``PIVOTS`` members, each with those near it that are of another class and
    have no pivot yet. A pivot is near more of a sample than others, of those that have none; a group of n gives at most n pairs."""
    x = _columns(cols)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(begin.tolist(), np.r_[begin[1:], len(group)].tolist(), strict=True):
        if b - a <= 4 * PIVOTS:
            continue
        all_ = np.arange(a, b)
        other = lambda p, all_=all_: _near(x, all_, p) & (x["class"][all_] != x["class"][p])
        sample = np.unique(np.linspace(a, b - 1, min(b - a, SAMPLE)).astype(np.int64))
        near = np.stack([other(p) for p in sample.tolist()], axis=1)
        open_ = np.ones(b - a, bool)
        for _ in range(PIVOTS):
            votes = near[:, open_[sample - a]].sum(axis=1)
            p = int(np.argmax(votes))
            if not votes[p]:
                break
            joins = np.flatnonzero(other(a + p) & open_)
            open_[joins] = open_[p] = False
            yield np.full(len(joins), a + p), a + joins


def near_pairs(group: np.ndarray, cols: dict):
    """Yield arrays (i, j) of all candidates of one group and different classes that may have a similarity of 0.8."""
    x = _columns(cols)
    order = np.lexsort((*x["fp"][:, :0:-1].T, gray_rank(x["fp"][:, 0]), group))
    x = {k: v[order] for k, v in x.items()}
    # of n hashes the other text has at most 5n/4, so that n/4 at most are in one only
    limit = np.where(x["kind"] == 0, x["n"] // 4, NEAR_BITS)
    for i, j in GrayIndex(group[order], x["fp"]).pairs(limit, x["class"]):
        ok = _near(x, i, j)
        yield order[i[ok]], order[j[ok]]


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes of shingles that many of ``texts.text`` have, the most frequent last. Tasks name what three of ``CHUNK``
    texts have; the list only says which shingles are candidates' keys last, so no link depends on it."""

    def make():
        def run(text):
            gram, count = np.unique(np.concatenate(shingle_sets(text)), return_counts=True)
            often = count > 2
            return {"gram": gram[often].view(np.int64), "n": count[often]}

        return run

    counts = arrow_map(texts.select("text"), "gram long, n long", make).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "gram").limit(LISTED).toArrow()
    return top.column("gram").to_numpy().view(np.uint64)[::-1].copy()


def candidate_keys(gram: np.ndarray, listed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of ascending hashes the first n/5 + 1 in one order for all texts: those not ``listed`` by hash, then by ``rank``."""
    if not len(gram):
        return gram
    n = len(gram) // 5 + 1
    at = np.searchsorted(listed, gram)
    known = np.r_[listed, np.uint64(0)][at] == gram if len(listed) else np.zeros(len(gram), bool)
    known &= at < len(listed)
    first = gram[~known][:n]
    if len(first) == n:
        return first
    return np.r_[first, gram[known][np.argsort(rank[at[known]])[: n - len(first)]]]


def _bits(a: str, b: str, of: str) -> Column:
    """The bits in which the fingerprints (f) or parities (p) of two aliased rows differ."""
    return sum((F.bit_count(F.col(f"{a}.{of}{k}").bitwiseXOR(F.col(f"{b}.{of}{k}"))) for k in range(NEAR_WORDS)), F.lit(0))


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, keep) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose texts have a similarity of 0.8 or more by their shingles; ``keep`` writes a table."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(True).alias("left")).union(pairs.select("b", F.lit(False)))
    ends = ends.groupBy("node").agg(F.max("left").alias("is_a"), F.min("left").alias("not_b"))
    ends = keep(ends.join(nodes.select("node", F.col("id").alias("nid"), F.col("th").alias("nth")), "node"))
    n = ends.count()
    parts = 1 + n // COMPARED  # whole texts are sorted and compared: small parts
    listed = F.broadcast(ends) if n <= BROADCAST_ROWS else ends
    same = F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth"))
    sides = keep(texts.join(listed, same).select("node", "text", "is_a", "not_b").repartition(parts, "node").dropDuplicates(["node"]))
    x, y = sides.filter("is_a").select(F.col("node").alias("a"), F.col("text").alias("x")), sides.filter("NOT not_b").select(F.col("node").alias("b"), F.col("text").alias("y"))
    both = pairs.repartition(parts, "a").join(x.repartition(parts, "a"), "a")
    both = both.repartition(parts, "b").join(y.repartition(parts, "b"), "b")

    def make():
        def run(a, b, x, y):
            at = {t: k for k, t in enumerate(dict.fromkeys(x + y))}
            sets = shingle_sets(list(at))
            near = []
            for s, t in zip((sets[at[t]] for t in x), (sets[at[t]] for t in y), strict=True):
                shared = len(np.intersect1d(s, t, assume_unique=True))
                near.append(5 * shared >= 4 * (len(s) + len(t) - shared))
            return {c: [v for v, ok in zip(col, near, strict=True) if ok] for c, col in (("a", a), ("b", b))}

        return run

    return keep(arrow_map(both.select("a", "b", "x", "y"), "a long, b long", make))


def near_links(rows: DataFrame, texts: DataFrame, keep=written) -> DataFrame:
    """Links (a, b), enough to join all nodes of a similarity of 0.8 or more. Of ``rows`` (node, id, th, n, f0.., p0.., keys) each
    stands for one of ``texts`` (id, th, text): a number of its shingles' set, how many they are, their fingerprint, parities and
    candidate keys, which copies may lack where one has them. ``keep`` writes a table and reads it again.

    Nodes of one key are a group. The first of each is compared with the others, which finds classes, and pivots of large
    groups while they join some; then all pairs of different classes that are left are. A hot group is cut into slices, of
    which each two meet, but for two of the first's class; for pivots the slices are dealt anew each time and do not meet."""
    sketch = [f"{x}{k}" for x in "fp" for k in range(NEAR_WORDS)]
    nodes = keep(rows.drop("keys").dropDuplicates(["node"]))
    marks = nodes.select("node", "n", *sketch)
    parts = 1 + (rows.agg(F.sum("n")).first()[0] or 0) // (5 * DEALT)
    keyed = rows.select("node", F.explode("keys").alias("key")).repartition(parts, "key")
    group = W.partitionBy("key")
    keyed = keyed.select("key", "node", F.min("node").over(group).alias("first"), F.max("node").over(group).alias("last"), F.count("node").over(group).alias("size"))
    shared = keep(keyed.filter("first != last").select("key", "node", "first", "size").distinct())
    stars = shared.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    ends = stars.join(marks.alias("x"), F.col("a") == F.col("x.node")).join(marks.alias("y"), F.col("b") == F.col("y.node"))
    sized = (5 * F.least("x.n", "y.n") >= 4 * F.greatest("x.n", "y.n")) & (9 * _bits("x", "y", "p") <= F.col("x.n") + F.col("y.n"))
    tried = keep(ends.filter(sized & (_bits("x", "y", "f") <= NEAR_BITS)).select("a", "b"))
    found = similar(tried, nodes, texts, keep)

    def open_groups(shared):
        """The members of groups of more than one class; of two members the pair is done."""
        classes = components(found).withColumnRenamed("v", "node")
        members = shared.join(classes, "node", "left").withColumn("class", F.coalesce("root", "node"))
        main = members.groupBy("key").agg(F.min_by("class", "node").alias("main"), F.count(F.lit(1)).alias("m"), F.min("class").alias("low"), F.max("class").alias("high"))
        return members.join(main.filter("m > 2 AND low != high"), "key")

    def candidates(cells, search):
        """Pairs of the members (key, cell, node, class) of one cell that ``search`` finds and were not compared."""
        kinds = F.when(F.col("n") < -(-4 * PARITY_SHINGLES // 5), F.array(F.lit(0))).when(F.col("n") <= PARITY_SHINGLES, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
        cells = cells.join(marks, "node").withColumn("kind", F.explode(kinds))
        words = (F.when(F.col("kind") == 0, F.col(f"p{k}")).otherwise(F.col(f"f{k}")).alias(f"w{k}") for k in range(NEAR_WORDS))
        cells = cells.select("key", "cell", "kind", "node", "class", F.col("n").cast("long").alias("n"), *words)
        pairs = _dealt(cells, ["key", "cell", "kind"], "node", search, HELD).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return keep(pairs.join(tried, ["a", "b"], "left_anti"))

    for k in range(ROUNDS):
        # size may count a node several times
        large = open_groups(shared.filter(F.col("size") > 4 * PIVOTS)).withColumn("cell", F.pmod(F.xxhash64("node", F.lit(k)), F.ceil(F.col("m") / HOT_GROUP)))
        more = candidates(large.select("key", "cell", "node", "class"), pivot_pairs)
        if more.isEmpty():
            break
        links = similar(more, nodes, texts, keep)
        tried, found = tried.union(more), found.union(links)
        if links.isEmpty():
            break

    # how many are of the first's class, and how many are not
    members = open_groups(shared).withColumn("out", F.col("class") != F.col("main"))
    cuts = members.groupBy("key").agg(F.ceil(F.sum(F.col("out").cast("long")) / HOT_GROUP).alias("o"), F.ceil(F.sum((~F.col("out")).cast("long")) / HOT_GROUP).alias("d"))
    members = members.select("key", "node", "class", "out", "m").join(cuts, "key")
    # slices of the others come first, then those of the first's class; the latter meet the former only
    members = members.withColumn("slice", F.when(F.col("out"), F.pmod(F.xxhash64("node"), "o")).otherwise(F.col("o") + F.pmod(F.xxhash64("node"), "d")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.when(F.col("out"), F.col("o") + F.col("d")).otherwise(F.col("o")) - 1), lambda j: F.least(j, "slice") * (F.col("o") + F.col("d")) + F.greatest(j, "slice"))
    members = members.withColumn("cell", F.explode(F.when(F.col("m") > HOT_GROUP, meets).otherwise(F.array(F.lit(0).cast("long")))))
    more = candidates(members.select("key", "cell", "node", "class"), near_pairs)
    return found if more.isEmpty() else found.union(similar(more, nodes, texts, keep))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id (rows without an id come
    last), of one id that of the smaller text hash. Texts that link with no other stay.

    Two texts link where their sets of five-word shingles, A-Z in lower case, have a similarity of 0.8 or more, and all
    that do are found. Null and blank texts are copies of one
    another. Of repeated rows one stays; rows of one id with different texts are judged by themselves;
    an empty table gives none. Names that begin with ``_near_`` are the operator's own and left out. Whole texts are
    shuffled only where more than ``BROADCAST_ROWS`` are to be compared: the rows that go are found by id and text
    hash, and only repeated rows that stay are dealt out.
    """
    cols = [c for c in df.columns if not c.startswith("_near_")]
    df = df.select(*cols)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    with small_batches(df.sparkSession):
        often = frequent_shingles(src)

    def make():
        from xxhash import xxh64_intdigest

        by_hash = np.argsort(often)
        listed = often[by_hash]
        seen: set[int] = set()  # a task's copies give the keys once

        def run(id, th, text):
            sets = shingle_sets(text)
            sketch = {f"{x}{k}": words[:, k].view(np.int64) for x, words in (("f", wide_fingerprints(sets)), ("p", parities(sets))) for k in range(NEAR_WORDS)}
            node = np.array([xxh64_intdigest(g.tobytes(), 42) for g in sets], np.uint64).view(np.int64)
            keys = []
            for g, k in zip(sets, node.tolist(), strict=True):
                keys.append(candidate_keys(g[:0] if k in seen else g, listed, by_hash).view(np.int64))
                seen.add(k)
            return {"id": id, "th": th, "node": node, "n": [len(g) for g in sets], "keys": keys} | sketch

        return run

    # what is written on the way is deleted at the end
    base = f"{shared_dir(df.sparkSession)}/near-{uuid4().hex}"
    keep = partial(written, folder=base)
    with small_batches(df.sparkSession):
        fps = keep(arrow_map(src, f"id {kind}, th long, node long, n int, keys array<long>" + "".join(f", {x}{k} long" for x in "fp" for k in range(NEAR_WORDS)), make))
        roots = components(near_links(fps, src, keep)).withColumnRenamed("v", "node")
        # rows of one id and text are one candidate to stay
        rows = fps.groupBy("node", "id", "th").agg(F.count(F.lit(1)).alias("n")).join(roots, "node", "left")
        rows = rows.withColumn("root", F.coalesce("root", "node")).withColumn("rank", F.struct(F.col("id").isNull().alias("none"), "id", "th"))
        best = rows.groupBy("root").agg(F.min("rank").alias("best"))
        rows = rows.join(best, "root").select("id", "th", "n", (F.col("rank") == F.col("best")).alias("stays"))
        rows = checkpointed(rows.filter("NOT stays OR n > 1").select(F.col("id").alias("_near_id"), F.col("th").alias("_near_th"), "stays"))
    drop_folder(df.sparkSession, base)
    by = {r.stays: r["count"] for r in rows.groupBy("stays").count().collect()}
    keyed = df.withColumn("_near_h", F.xxhash64(text_col))
    listed = F.broadcast(rows) if sum(by.values()) <= BROADCAST_ROWS else rows
    same = F.col(id_col).eqNullSafe(F.col("_near_id")) & (F.col("_near_h") == F.col("_near_th"))
    out = keyed.join(listed, same, "left_anti")
    if by.get(True):  # repeated rows
        out = out.unionByName(keyed.join(listed.filter("stays"), same, "left_semi").dropDuplicates([id_col, "_near_h"]))
    return out.select(*cols)
