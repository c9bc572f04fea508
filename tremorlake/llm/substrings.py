"""Repeated passages by prefix-partitioned suffix trees, cut at the depth of a window.

A suffix is a word's place in a text with the words that follow. Its prefix, of variable length, ends
with the smallest hash of four words that begins within the window, so equal windows have equal
prefixes, whatever surrounds them, and neighbouring suffixes mostly share that last part, the anchor,
and travel together as one stretch of words. Four words that very many places have are counted first
and are no anchors: a prefix then goes on to rarer words, and where a window has none it is the prefix
itself. Prefixes are dealt to groups of a size that fits in memory.

In a group, suffixes are sorted by their words and the lengths of common prefixes of neighbours give
the subtree's internal nodes; those as deep as a window are repeats. The first leaf of such a node
stays, the others are repeats, and runs of them in a text are the maximal repeats. Windows that share
their hash with no other have no deep node above them and are left out of the sort; all others
are told apart by their words.

Each task first builds the tree of its own chunk of texts and sends one leaf of each deep node, so
a passage that a third of all texts share reaches its group once a chunk.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import arrow_map, split_words

WINDOW = 20
ANCHOR = 4
#: Words of a chunk whose tree is built at once in a task.
CHUNK_WORDS = 700_000
#: Bytes of words of a group; a group that is larger all the same is worked off in parts.
GROUP_BYTES = 24 << 20
#: Most partitions; beyond it a partition has several groups, one after the other.
MOST_PARTITIONS = 50_000
#: Counters of an anchor's words by hash, the least count in a task that is sent on, and the count beyond which they are no anchor.
SLOTS = 1 << 22
LEAST_COUNT = 16
HOT_COUNT = 200_000
#: Bytes of words that are hashed at once.
HASH_BYTES = 1 << 20
#: Suffixes of equal hashes that are sorted by their words at once.
SORT_ROWS = 200_000
#: Places of a stretch, and of a mask of marked places.
STRETCH = 16

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LEAST = -(1 << 63)
_TOP = np.uint64((1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def rolling(r: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring values, put together from those of powers of two."""
    out, done, at, power, k = None, 0, r, int(_M1), 1  # ``at`` has the hashes of k values
    while True:
        if width & k:
            n = max(0, len(r) - done - k + 1)
            out = at[:n] if out is None else out[:n] * np.uint64(power) + at[done : done + n]
            done += k
        if done == width:
            return _mix(out)
        at = at[: max(0, len(at) - k)] * np.uint64(power) + at[k:]
        power, k = power * power % (1 << 64), 2 * k


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    k = 1
    while 2 * k <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (width - k)], v[width - k :]) if width > k else v


class WordHasher:
    """Hashes of words set apart by one space, from sums of their bytes times powers, many words at once."""

    def __init__(self):
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(HASH_BYTES, _M2)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(HASH_BYTES, np.uint64(pow(int(_M2), -1, 1 << 64)))])

    def __call__(self, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hashes, and the place of each word's first byte with one place more: the end and a space."""
        from xxhash import xxh64_intdigest

        raw = np.frombuffer(flat, np.uint8)
        byte = np.r_[0, np.flatnonzero(raw == 32) + 1, len(raw) + 1]
        out = np.empty(len(byte) - 1, np.uint64)
        a = 0
        while a < len(out):
            b = int(np.searchsorted(byte, byte[a] + HASH_BYTES, "right")) - 1
            if b <= a:  # a word longer than all that is hashed at once
                out[a] = xxh64_intdigest(flat[byte[a] : byte[a + 1] - 1])
                a += 1
                continue
            at = byte[a : b + 1] - byte[a]
            part = raw[byte[a] : byte[b] - 1].astype(np.uint64) + np.uint64(1)
            total = np.r_[np.uint64(0), np.cumsum(part * self.up[: len(part)])]
            out[a:b] = (total[at[1:] - 1] - total[at[:-1]]) * self.down[at[:-1]]
            a = b
        return _mix(out ^ _M3), byte


def later_leaves(flat: bytes, byte: np.ndarray, start: np.ndarray, label: np.ndarray, window: int, rank) -> np.ndarray:
    """Which suffixes stand under a node at least ``window`` words deep and are not its first leaf.

    ``byte`` has the places of the words of ``flat``, ``start`` the words at which the suffixes begin, ``label`` their
    windows' hashes; ``rank`` gives numbers of some suffixes that order them (equal ones are one leaf)."""
    again = np.zeros(len(start), bool)
    order = np.argsort(label, kind="stable")
    same = label[order[1:]] == label[order[:-1]]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    if not len(order):
        return again
    turn = np.flatnonzero(np.r_[True, label[order[1:]] != label[order[:-1]]])
    cut = turn[np.flatnonzero(np.diff(turn // SORT_ROWS)) + 1]
    for some in np.split(order, cut):
        first, past = byte[start[some]].tolist(), (byte[start[some] + window] - 1).tolist()
        suffix = [flat[a:b] for a, b in zip(first, past, strict=True)]  # as deep as a window
        by_words = np.array(sorted(range(len(suffix)), key=suffix.__getitem__), np.int64)
        # neighbours in suffix order that are equal to this depth share a node as deep or deeper
        deep = np.fromiter((suffix[a] == suffix[b] for a, b in pairwise(by_words.tolist())), bool, len(some) - 1)
        some = some[by_words]
        node = np.cumsum(np.r_[True, ~deep]) - 1
        number = rank(some)
        least = np.minimum.reduceat(number, np.flatnonzero(np.r_[True, ~deep]))
        again[some] = number > least[node]
    return again


def _masks(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of documents, each once, as (document, first place, bits of the places from there)."""
    if not len(doc):
        return doc, pos, pos
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    head = pos // STRETCH
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (head[1:] != head[:-1])])
    return doc[new], head[new] * STRETCH, np.bitwise_or.reduceat(1 << pos % STRETCH, new)


_HEAD = "<III"  # numbers of stretches and marks, bytes of words


def _pack(press, d, th, pos, bits, text: bytes, marks) -> bytes:
    """Stretches and marks of one group as bytes: the numbers of both, their columns, the stretches' words."""
    cols = [np.asarray(d, "<i8"), np.asarray(th, "<i8"), np.asarray(pos, "<i4"), np.asarray(bits, "<u4"), *(np.asarray(m, t) for m, t in zip(marks, ("<i8", "<i8", "<i4", "<u4"), strict=True))]
    return press.compress(struct.pack(_HEAD, len(d), len(marks[0]), len(text)) + b"".join(c.tobytes() for c in cols) + text)


def _unpack(raw: bytes) -> tuple[list[np.ndarray], bytes, list[np.ndarray]]:
    n, m, size = struct.unpack_from(_HEAD, raw)
    at, cols = struct.calcsize(_HEAD), []
    for count in (n, m):
        for t, width in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("<u4", 4)):
            cols.append(np.frombuffer(raw, t, count, at))
            at += count * width
    return cols[:4], raw[at : at + size], cols[4:]


class Chunk:
    """Texts of a task, up to ``CHUNK_WORDS`` words at once; longer texts are cut into segments that overlap by
    a window less one word, so that each place has its window in one segment."""

    def __init__(self, window: int):
        self.window, self.held, self.words = window, {}, 0

    def add(self, d: int, th: int, text: bytes):
        words = text.split()
        for a in range(0, len(words) - self.window + 1, CHUNK_WORDS):
            part = words[a : a + CHUNK_WORDS + self.window - 1]
            if (d, th, a) not in self.held:
                self.held[d, th, a] = (b" ".join(part), len(part))
                self.words += len(part)
            if self.words >= CHUNK_WORDS:
                yield self.taken()

    def taken(self) -> tuple[list[tuple[int, int, int]], np.ndarray, bytes]:
        """The texts' keys (id, text hash, first place) in order, their numbers of words, and the words."""
        keys = sorted(self.held)
        sizes = np.array([self.held[k][1] for k in keys], np.int64)
        flat = b" ".join(self.held[k][0] for k in keys)
        self.held, self.words = {}, 0
        return keys, sizes, flat


def _chunks(batches, window: int):
    chunk = Chunk(window)
    for batch in batches:
        for d, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if text.is_valid:
                yield from chunk.add(d, th, text.as_buffer().to_pybytes())
    if chunk.held:
        yield chunk.taken()


def prefix_counts(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Counts of ``anchor`` words by hash: (slot, n) of those that a task has ``LEAST_COUNT`` times or more, and the
    number of all words under slot -1."""

    def run(batches):
        seen, total, hashed = np.zeros(SLOTS, np.int64), 0, WordHasher()
        for _, sizes, flat in _chunks(batches, window):
            total += int(sizes.sum())
            seen += np.bincount((rolling(hashed(flat)[0], anchor) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(seen >= LEAST_COUNT)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.r_[-1, slot], pa.int32()), "n": pa.array(np.r_[total, seen[slot]], pa.int64())})

    return texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def chunk_stretches(keys, sizes, flat: bytes, window: int, anchor: int, hot: np.ndarray | None, n_groups: int, press, hashed: WordHasher):
    """The stretches of one chunk as (group, bytes): neighbouring suffixes of one text and one anchor, without
    those that an earlier suffix of the chunk repeats, and the marks of these."""
    hashes, byte = hashed(flat)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(keys)), sizes)
    grams = rolling(hashes, anchor)
    if hot is not None:
        grams[hot[(grams % np.uint64(SLOTS)).astype(np.int64)]] = _TOP
    start = np.flatnonzero(np.arange(len(hashes)) + window <= ends[doc])
    label = rolling(hashes, window)[start]
    prefix = _least(grams, window - anchor + 1)[start]
    prefix = np.where(prefix == _TOP, label, prefix)
    again = later_leaves(flat, byte, start, label, window, lambda some: some)
    doc = doc[start]
    d, th, base = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    pos = start - (ends - sizes)[doc] + base[doc]
    # a stretch ends with its anchor or text, and after so many places
    n = np.arange(len(start))
    new = np.r_[True, (prefix[1:] != prefix[:-1]) | (doc[1:] != doc[:-1])]
    inside = n - np.maximum.accumulate(np.where(new, n, 0))
    begin = np.flatnonzero(new | (inside % STRETCH == 0))
    of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(n)]))
    low = np.minimum.reduceat(np.where(again, len(n), n), begin)
    high = np.maximum.reduceat(np.where(again, -1, n), begin)
    bits = np.add.reduceat(np.where(again, 0, 1 << np.maximum(0, n - low[of])), begin)
    sent = np.flatnonzero(high >= 0)
    low, high, bits = low[sent], high[sent], bits[sent]
    group = (prefix[low] >> np.uint64(1)).astype(np.int64) % n_groups
    order = np.argsort(group, kind="stable")
    mark_doc, mark_pos, mark_bits = _masks(doc[again], pos[again])
    marks = (d[mark_doc], th[mark_doc], mark_pos, mark_bits)
    none = tuple(m[:0] for m in marks)
    if len(marks[0]):
        yield int(marks[1][0] % n_groups), _pack(press, [], [], [], [], b"", marks)
    first, past = byte[start[low]], byte[start[high] + window] - 1
    for some in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
        text = b" ".join([flat[a:b] for a, b in zip(first[some].tolist(), past[some].tolist(), strict=True)])
        at = low[some]
        yield int(group[some[0]]), _pack(press, d[doc[at]], th[doc[at]], pos[at], bits[some], text, none)


def _stretches(texts: DataFrame, window: int, anchor: int, hot: Broadcast | None, n_groups: int) -> DataFrame:
    def run(batches):
        import zstandard

        press, hashed = zstandard.ZstdCompressor(level=1), WordHasher()
        known = None if hot is None else np.unpackbits(np.frombuffer(hot.value, np.uint8), count=SLOTS).astype(bool)
        for keys, sizes, flat in _chunks(batches, window):
            rows = list(chunk_stretches(keys, sizes, flat, window, anchor, known, n_groups, press, hashed))
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                yield pa.RecordBatch.from_pydict({"g": pa.array([g for g, _ in part], pa.int32()), "packed": pa.array([x for _, x in part], pa.binary())})

    return texts.mapInArrow(run, "g int, packed binary")


class Subtree:
    """The suffixes of a group. Where they outgrow ``GROUP_BYTES``, deep nodes are reduced to their first leaf
    before more are taken, so memory follows the different windows and not their repeats."""

    def __init__(self, window: int):
        self.window, self.cols, self.texts, self.bytes, self.limit = window, [], [], 0, GROUP_BYTES
        self.hashed = WordHasher()

    def add(self, raw: bytes):
        cols, text, marks = _unpack(raw)
        if len(marks[0]):
            yield tuple(marks)
        if len(cols[0]):
            self.cols.append(cols)
            self.texts.append(text)
            self.bytes += len(text)
        if self.bytes > self.limit:
            yield self.reduced(True)
            self.limit = max(GROUP_BYTES, 2 * self.bytes)

    def reduced(self, go_on: bool = False):
        """Marks of the leaves that are not the first of a deep node; with ``go_on`` the others are kept."""
        if not self.cols:
            return None
        d, th, pos, bits = (np.concatenate([c[k] for c in self.cols]).astype(np.int64) for k in range(4))
        flat = b" ".join(self.texts)
        self.cols, self.texts, self.bytes = [], [], 0
        hashes, byte = self.hashed(flat)
        last = np.floor(np.log2(bits)).astype(np.int64)
        size = last + self.window
        begin = np.cumsum(size) - size
        of, nth = np.nonzero(bits[:, None] >> np.arange(STRETCH) & 1)
        start = begin[of] + nth
        label = rolling(hashes, self.window)[start]

        def rank(some):
            key = (pos[of[some]] + nth[some], th[of[some]], d[of[some]])
            order = np.lexsort(key)
            new = np.logical_or.reduce([np.r_[False, k[order][1:] != k[order][:-1]] for k in key])
            out = np.empty(len(some), np.int64)
            out[order] = np.cumsum(new)
            return out

        again = later_leaves(flat, byte, start, label, self.window, rank)
        doc = np.unique(np.c_[d, th], axis=0, return_inverse=True)
        who, place, mask = _masks(doc[1].ravel()[of[again]], pos[of[again]] + nth[again])
        if go_on:
            left = np.zeros(len(bits), np.int64)
            np.bitwise_or.at(left, of[~again], 1 << nth[~again])
            # of rows of one text, one stretch is enough
            _, once = np.unique(np.c_[d, th, pos, left], axis=0, return_index=True)
            once = once[left[once] > 0]
            past = begin[once] + np.floor(np.log2(left[once])).astype(np.int64) + self.window
            self.texts = [flat[a:b] for a, b in zip(byte[begin[once]].tolist(), (byte[past] - 1).tolist(), strict=True)]
            self.cols = [[d[once], th[once], pos[once], left[once]]] if len(once) else []
            self.bytes = sum(map(len, self.texts))
        return doc[0][who, 0], doc[0][who, 1], place, mask


def _marks(stretches: DataFrame, window: int, n_groups: int) -> DataFrame:
    """Marked places of all texts: (d, th, pos, mask)."""
    n = min(n_groups, MOST_PARTITIONS)
    dealt = stretches.repartitionById(n, F.col("g") % n)
    if n_groups > n:
        dealt = dealt.sortWithinPartitions("g")

    def run(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        tree, group = Subtree(window), None

        def rows(marks):
            for m in marks:
                if m is not None and len(m[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(m, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["d", "th", "pos", "mask"])

        for batch in batches:
            for g, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if g != group and n_groups > n:
                    yield from rows([tree.reduced()])
                    tree, group = Subtree(window), g
                yield from rows(tree.add(open_.decompress(packed.as_buffer())))
        yield from rows([tree.reduced()])

    return dealt.mapInArrow(run, "d long, th long, pos int, mask int")


def _packed(src: DataFrame) -> DataFrame:
    """Texts compressed for the way to their marks, which halves what is shuffled."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [press.compress(t.as_buffer().to_pybytes()) if t.is_valid else None for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary())], names=["id", "d", "th", "packed"])

    return src.mapInArrow(run, "id long, d long, th long, packed binary")


def covered(n_words: int, marks: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which words a marked window covers; ``marks`` are (first place, bits of the marked places from there)."""
    edge = np.zeros(n_words + 1, np.int64)
    if marks:
        pos, mask = np.array(marks, np.int64).T
        bits = mask[:, None] >> np.arange(STRETCH) & 1
        start = (pos[:, None] + np.arange(STRETCH))[bits == 1]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_words``, ``n_removed``, the SHA-256 of the kept words joined by one
    space, the maximal repeats removed as (first word, number of words), and the kept text if ``keep_text``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. Windows are judged on the input, by their words. Ids are longs; a null
    id counts as the smallest. Rows of equal id and text are one document and share the result;
    of equal ids with different texts, that of the smaller text hash comes first; texts of one id, or without
    an id, are told apart by 64 bits. A null text has no words; texts shorter than a window lose
    nothing; an empty table gives no rows. Only the two named columns are read. Prefixes are counted by a job
    of its own when the plan is made.
    """
    anchor = min(ANCHOR, window)
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    src = src.select("id", F.coalesce("id", F.lit(_LEAST)).alias("d"), F.xxhash64("text").alias("th"), "text")
    texts = src.select("d", "th", "text")
    # at most SLOTS rows, whatever the data
    counts = {r.slot: r.n for r in prefix_counts(texts, window, anchor).filter((F.col("slot") < 0) | (F.col("n") > HOT_COUNT)).collect()}
    n_words = counts.pop(-1, 0)
    hot = None
    if counts:
        bits = np.zeros(SLOTS, bool)
        bits[list(counts)] = True
        hot = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
    # a suffix travels with about three words of seven bytes
    n_groups = max(2 * spark.sparkContext.defaultParallelism, -(-n_words * 21 // GROUP_BYTES))
    marks = _marks(_stretches(texts, window, anchor, hot, n_groups), window, n_groups)
    marks = marks.groupBy("d", "th").agg(F.collect_list(F.struct("pos", "mask")).alias("marks"))
    rows = _packed(src).join(marks, ["d", "th"], "left").select("id", "packed", "marks")
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def make():
        import zstandard

        open_ = zstandard.ZstdDecompressor()

        def f(id, packed, marks):
            text = [p and open_.decompress(p).decode("utf-8", "surrogatepass") for p in packed]
            out = {id_col: id, "n_words": [], "n_removed": [], "kept_sha256": [], "repeats": []} | ({"kept_text": []} if keep_text else {})
            for t, m in zip(text, marks, strict=True):
                words = split_words(t or "")
                gone = covered(len(words), [(x["pos"], x["mask"]) for x in m or []], window)
                kept = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if m else " ".join(words)
                turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                out["repeats"].append([{"first": int(a), "words": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                if keep_text:
                    out["kept_text"].append(kept)
            return out

        return f

    return arrow_map(rows, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first:int,words:int>>" + ", kept_text string" * keep_text, make)
