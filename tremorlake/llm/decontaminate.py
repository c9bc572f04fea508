"""Benchmark decontamination by spaced-seed hashing.

Fixed masks read some of the words of a stretch and ignore the others, so a stretch with substituted
words still hits where the mask looks past them; short items have shorter masks. Hashes of the benchmark are joined with those of
every place of every text; around a hit, text and item are compared word by word along the
hit's diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import arrow_keep, checkpointed

# The masks; 1 reads a word, 0 ignores it.
MASKS = ("1101011", "11001011", "1011001001", "100110010001")
#: Items of fewer words are matched whole; those of up to 12 words have shorter masks.
SHORTEST = 7
SHORT_MASKS = ("1111", "11011", "1110111")
#: Each mask with the least and most words of the items that it reads. Together they hit every overlap that
#: passes: of the whole items, only some of 15 and 16 words with three substitutions need the fifth long mask.
SEEDS = (
    *(("1" * n, n, n) for n in range(1, SHORTEST)),
    *((m, SHORTEST, 12) for m in SHORT_MASKS),
    *((m, 13, 1 << 62) for m in MASKS),
    ("11110100011", 15, 16),
)
MIN_WORDS = 13
SIMILARITY = 0.8
#: Benchmark words held in a block; each block is broadcast by itself and meets all texts.
BLOCK_WORDS = 2_000_000
#: Hits of seeds compared at once in a task.
HITS = 1 << 18

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words of letters in lower case, ASCII digits and all other characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _seed_keys(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where every word that the mask reads is known (not -1), and their hashes."""
    reads = [k for k, c in enumerate(mask) if c == "1"]
    at = np.arange(max(0, len(ids) - len(mask) + 1))
    for k in reads:
        at = at[ids[at + k] >= 0]
    key = np.zeros(len(at), np.uint64)
    for k, m in zip(reads, _ODD, strict=False):
        key = (key ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * m
        key ^= key >> np.uint64(31)
    return at, key


class SeedIndex:
    """The seeds of a block of benchmark items, [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[tuple[str, int, int], ...] = SEEDS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY):
        split = [words_of(t) for _, t in items]
        self.item_ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        size = np.array([len(w) for w in split], np.int64)
        self.begin = np.r_[0, np.cumsum(size)]
        self.flat = np.fromiter((self.vocab[w] for words in split for w in words), np.int64, int(size.sum()))
        self.masks, self.min_words, self.similarity = [m for m, _, _ in masks], min_words, similarity
        self.whole = [high < SHORTEST for _, _, high in masks]
        self.keys, self.places = [], []
        for mask, low, high in masks:
            at, key = _seed_keys(self.flat, mask)
            item = np.searchsorted(self.begin, at, "right") - 1
            inside = (at + len(mask) <= self.begin[item + 1]) & (size[item] >= low) & (size[item] <= high)
            at, key = at[inside], key[inside]
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.places.append(at[order])

    @classmethod
    def of(cls, state: dict) -> SeedIndex:
        """An index from the plain values that a broadcast carries, so that workers need no copy of the library."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, number of words, equal words) of the overlap with the most equal words of
        each pair that passes. Hits are expanded and compared about ``HITS`` at a time, however many
        items share a seed."""
        get = self.vocab.get
        ids = [np.fromiter((get(w, -1) for w in words_of(t)), np.int64) for t in texts]
        size = np.array([len(x) for x in ids], np.int64)
        begin = np.r_[0, np.cumsum(size)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        held: list[np.ndarray] = []
        # a diagonal as one number: text, item, and where the item's first word would stand in the text
        before = int(np.diff(self.begin).max(initial=0))
        span = before + int(size.max(initial=0)) + 1
        for mask, whole, keys, places in zip(self.masks, self.whole, self.keys, self.places, strict=True):
            if not len(keys):
                continue
            at, key = _seed_keys(flat, mask)
            doc = np.searchsorted(begin, at, "right") - 1
            inside = at + len(mask) <= begin[doc + 1]
            at, key, doc = at[inside], key[inside], doc[inside]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(high > low)
            for part in _slices(hit, (high - low)[hit], HITS):
                n = high[part] - low[part]
                d, where = np.repeat(doc[part], n), np.repeat(at[part], n)
                place = places[np.repeat(low[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                item = np.searchsorted(self.begin, place, "right") - 1
                if whole:  # the seed is the item: equal words are the overlap, the first one counts
                    k = np.arange(len(mask))
                    same = (flat[where[:, None] + k] == self.flat[place[:, None] + k]).all(axis=1)
                    for d, i, w in np.c_[d, item, where - begin[d]][same].tolist():
                        out.setdefault((d, i), (w, len(mask), len(mask)))
                    continue
                shift = where - begin[d] - (place - self.begin[item])
                held.append(np.unique((d * len(self.item_ids) + item) * span + shift + before))
                if sum(map(len, held)) > HITS:
                    self._compare(held, span, before, flat, begin, out)
                    held = []
        if held:
            self._compare(held, span, before, flat, begin, out)
        return [(d, i, *v) for (d, i), v in sorted(out.items())]

    def _compare(self, held, span, before, flat, begin, out) -> None:
        """Compares texts and items along diagonals and puts the overlaps that pass into ``out``."""
        code = np.unique(np.concatenate(held))
        pair, shift = code // span, code % span - before
        doc, item = pair // len(self.item_ids), pair % len(self.item_ids)
        length = self.begin[item + 1] - self.begin[item]
        a = np.maximum(0, -shift)
        n = np.minimum(length, begin[doc + 1] - begin[doc] - shift) - a
        least = np.minimum(self.min_words, length)
        need = np.ceil(self.similarity * least - 1e-9)
        for part in _slices(np.flatnonzero(n >= least), n[n >= least], 4 * HITS):
            m = n[part]
            start = np.cumsum(m) - m
            k = np.arange(m.sum()) - np.repeat(start, m)
            equal = flat[np.repeat(begin[doc[part]] + shift[part] + a[part], m) + k] == self.flat[np.repeat(self.begin[item[part]] + a[part], m) + k]
            total = np.r_[0, np.cumsum(equal)]
            window = np.flatnonzero(k + np.repeat(least[part], m) <= np.repeat(m, m))  # where a window of the least length fits
            good = np.zeros(len(k), bool)
            good[window] = total[window + np.repeat(least[part], m)[window]] - total[window] >= np.repeat(need[part], m)[window]
            sums = total[start + m] - total[start]
            passed = np.flatnonzero(np.logical_or.reduceat(good, start) | (sums >= self.similarity * length[part])) if len(part) else part
            for x in passed[np.argsort(-sums[passed], kind="stable")].tolist():
                y = part[x]
                key = int(doc[y]), int(item[y])
                if sums[x] > out.get(key, (0, 0, 0))[2]:  # an overlap has no more equal words than its diagonal
                    first, last = _longest(equal[start[x] : start[x] + m[x]], self.similarity)
                    same = int(total[start[x] + last] - total[start[x] + first])
                    if same > out.get(key, (0, 0, 0))[2]:
                        out[key] = int(a[y] + shift[y] + first), last - first, same


def _slices(rows: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """``rows`` cut so that the sizes of each part add up to about ``most``."""
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1) if len(rows) else []


def _longest(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest stretch of which a share of ``similarity`` is equal, from its first to its last equal word."""
    over = np.r_[0, np.cumsum(equal)] - similarity * np.arange(len(equal) + 1)
    reach = np.maximum.accumulate(over[::-1])[::-1]  # falls from left to right
    last = np.searchsorted(-reach, -(over - 1e-9), "right") - 1
    first = int(np.argmax(last - np.arange(len(over))))
    same = np.flatnonzero(equal[first : last[first]])
    return first + int(same[0]), first + int(same[-1]) + 1


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's seed indexes, each broadcast, in blocks of about ``BLOCK_WORDS`` words by hash of the id, and
    whether there are several; sizes are counted before any block comes to the driver, which holds one at a time."""
    items = benchmark.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).filter("id IS NOT NULL")
    sized = items.withColumn("h", F.xxhash64("id", "text")).withColumn("n", F.octet_length("text"))
    n_blocks = 1
    while True:
        worst = sized.groupBy(F.pmod("h", F.lit(n_blocks)).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).agg(F.max(F.when(F.col("c") > 1, F.col("n")))).first()[0]
        if not worst or worst <= 12 * BLOCK_WORDS:
            break
        n_blocks *= 2
    for b in range(n_blocks):
        part = sized.filter(F.pmod("h", F.lit(n_blocks)) == b).select("id", "text").distinct().orderBy("id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(vars(SeedIndex([(r.id, r.text) for r in part]))), n_blocks > 1


def _done(df: DataFrame, block: Broadcast, several: bool) -> DataFrame:
    """``df``; of several blocks, each one's result is written before the block is dropped and the next one comes."""
    if several:
        df = checkpointed(df)
        block.destroy()
    return df


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that overlap: ids, the overlap's first word and number of
    words in the document, its equal words and their share.

    Pairs overlap where of 13 words side by side (or of a whole shorter item) 0.8 or more are equal, or of
    the whole item. Told is the longest stretch with that share of equal words, from its first to
    its last equal word; of several, the one with the most equal words, then the first. Items of fewer than seven words
    match where all their words stand side by side; items without words match nothing. The masks hit
    every overlap so defined, whatever its length (``tests/llm`` counts it out). Null texts and null item ids match nothing; repeated rows
    give repeated rows; an empty table on either side gives none. Only the named columns are read.
    """
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind, item_kind = df.select(id_col).schema[0].dataType.simpleString(), benchmark.select(item_col).schema[0].dataType.simpleString()
    names = [id_col, item_col, "first_word", "n_words", "n_equal", "similarity"]
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, first_word long, n_words long, n_equal long, similarity double"
    out = None
    for block, several in blocks(benchmark, item_col, item_text):

        def run(batches, block=block):
            index = SeedIndex.of(block.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    found = index.matches(texts)
                    cols = [[ids[d] for d, *_ in found], [index.item_ids[i] for _, i, *_ in found], *([x[k] for x in found] for k in (2, 3, 4)), [x[4] / x[3] for x in found]]
                    types = [part.schema.field(0).type, pa.int64() if item_kind == "bigint" else None, pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        part = _done(src.mapInArrow(run, schema), block, several)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` that overlap no benchmark item, with all their columns; one pass a block, no shuffle.
    Null and empty texts stay, and so do all rows where the benchmark is empty; repeated rows share their fate."""
    for block, several in blocks(benchmark, item_col, item_text):

        def make(block=block):
            index = SeedIndex.of(block.value)

            def f(texts):
                hit = {d for d, *_ in index.matches(texts)}
                return [i not in hit for i in range(len(texts))]

            return f

        df = _done(arrow_keep(df, [text_col], make), block, several)
    return df
