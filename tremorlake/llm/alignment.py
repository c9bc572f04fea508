"""Alignment of two tokenizers over a corpus, with link counts in dense vectors behind a minimal perfect hash.

The first pass aligns documents and writes the distinct token pairs that each task saw, with the number of its documents. The
distinct pairs of the corpus are dealt to shards of bounded size, and each shard gets a minimal perfect hash: levels of bit
arrays in which a key's bit is set where no other key falls on it, numbered by the bits before. Counts are
vectors indexed by that hash, summed in a tree; the keys kept beside it tell a pair that is not there. The second pass aligns
again and looks counts up. Shards go to the workers in blocks of a bounded number of keys.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.bpe import byte_letters
from tremorlake.llm.common import drop_folder, shared_dir

#: Distinct pairs of a shard, on average, and of the shards that are broadcast at once.
SHARD_KEYS = 1 << 15
BLOCK_KEYS = 1 << 22
#: Segments of text that a task keeps aligned; beyond it half of them go, but the first ones, which are the frequent ones, stay.
CACHE_SEGMENTS = 600_000
#: Characters of texts that a task works on at once.
BATCH_CHARS = 500_000
#: Segments that are encoded in one call.
JOINED = 1000
#: Pairs of documents that a task holds before it counts them.
HELD_PAIRS = 1 << 20
#: Links of a group beyond which equal ids of a side are counted first.
LARGE_GROUP = 1 << 16
#: Room of a level of the hash, in times of its keys.
GAMMA = 2
#: Partial vectors of one shard that are summed at once.
FAN_IN = 16

# Both tokenizers end a token before a space that follows a non-space and precedes a word, so texts are cut there.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")

# Fixed value: the pattern of the first vocabulary's words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of keys (unsigned), another one for each seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def levels_of(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: the sizes of its levels, their bits in one array, and the keys in hash order."""
    sizes, bits, placed = [], [], []
    while len(keys):
        size = GAMMA * len(keys)
        at = (mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        level = np.zeros(size, bool)
        level[at[alone]] = True
        placed.append(keys[alone][np.argsort(at[alone])])
        sizes.append(size)
        bits.append(level)
        keys = keys[~alone]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(placed) if placed else np.zeros(0, np.int64)


class PerfectHash:
    """Looks up keys of a block of shards: the shard by a key's ``mix``, then its levels in turn, then the key itself."""

    def __init__(self, shards: int, rows: list[dict]):
        """``rows``: shard, sizes, bits (packed) and keys of each shard of the block."""
        self.shards = shards
        depth = max([len(r["sizes"]) for r in rows], default=0)
        self.size = np.zeros((shards, depth), np.int64)
        self.start = np.zeros((shards, depth), np.int64)
        bits, at = [], 0
        for r in rows:
            for k, n in enumerate(r["sizes"]):
                self.size[r["shard"], k], self.start[r["shard"], k] = n, at
                at += n
            bits.append(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=sum(r["sizes"])).astype(bool))
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.keys = np.concatenate([np.asarray(r["keys"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key in the block, or -1."""
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        shard = (mix(keys, 99) % np.uint64(self.shards)).astype(np.int64)
        for k in range(self.size.shape[1]):
            size = self.size[shard[live], k]
            live, size = live[size > 0], size[size > 0]
            at = self.start[shard[live], k] + (mix(keys[live], k) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at]
            out[live[hit]] = self.rank[at[hit]]
            live = live[~hit]
        found = out >= 0
        found[found] = self.keys[out[found]] == keys[found]
        return np.where(found, out, -1)


class Aligner:
    """Tokens of both vocabularies over segments of texts, their groups and links; all of many segments at once."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece

        self.a_file, self.a = a_file, None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        byte = {c: i for i, c in enumerate(byte_letters())}
        spec = json.loads(a_file)
        vocab = spec["model"]["vocab"]
        names = vocab | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.a_bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # where ids follow the order of merges, a rank encoder gives the same ids, and faster
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.fast = None
        if all(vocab[x + y] == 256 + i for i, (x, y) in enumerate(merges)) and all(vocab[c] < 256 for c in byte):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values() if i < 256 + len(merges)}, special_tokens={}).encode_ordinary

    def _by_library(self, segments: list[str]) -> list[list[int]]:
        if self.a is None:
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_buffer(self.a_file)
            self.a.encode_special_tokens = True
        return [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]

    def _joined(self, segments: list[str]) -> tuple | None:
        """Ids of both and their numbers by segment, from one call over all segments; None if they do not give the bytes back or
        do not end with the segments."""
        text = " ".join(segments)
        raw = (" " + text).encode()
        stop = np.cumsum([1 + (len(s) if s.isascii() else len(s.encode())) for s in segments])
        out = []
        for ids, table, length in ((self.fast(" " + text), self.a_bytes, self.a_len), (self.b.encode(text), self.b_bytes, self.b_len)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, np.int64)
            ends = np.cumsum(length[ids])
            at = np.searchsorted(ends, stop)
            if not np.array_equal(ends[at], stop):
                return None
            out += [ids, np.diff(np.r_[-1, at])]
        return tuple(out)

    def encode(self, segments: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The segments in another order, ids of both with their numbers by segment, and whether their bytes are those of a space
        and the segment; of others there are no ids."""
        # Latin letters have one class in every version of Unicode; other segments go by the vocabulary's own library
        plain, rest = [], []
        for s in segments:
            (plain if self.fast and s and not s[0].isspace() and s[-1] != " " and max(s) < "\u0250" else rest).append(s)
        done, parts = [], []
        for at in range(0, len(plain), JOINED):
            if (got := self._joined(own := plain[at : at + JOINED])) is None:
                rest += own
            else:
                done += own
                parts.append(got)
        ok = np.ones(len(segments), bool)
        if rest:
            a, b = self._by_library(rest), self.b.encode(rest, num_threads=1)
            for i, s in enumerate(rest):
                raw = (" " + s).encode()
                if any(b"".join(map(table.__getitem__, ids)) != raw for ids, table in ((a[i], self.a_bytes), (b[i], self.b_bytes))):
                    ok[len(done) + i], a[i], b[i] = False, [], []
            parts.append(tuple(x for ids in (a, b) for x in (np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(y) for y in ids], np.int64))))
        return done + rest, *(np.concatenate(x) for x in zip(*parts, strict=True)), ok


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Aligned:
    """Segments with their figures in columns, and their links in one flat array of pairs."""

    def __init__(self, fa: np.ndarray, n_a: np.ndarray, fb: np.ndarray, n_b: np.ndarray, aligner: Aligner, texts: bool):
        n = len(n_a)
        self.n_a, self.n_b = n_a, n_b
        end_a, end_b = np.cumsum(aligner.a_len[fa]), np.cumsum(aligner.b_len[fb])
        both = end_a[np.isin(end_a, end_b, assume_unique=True)]
        ga, gb = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        of_a, of_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        size_a, size_b = np.bincount(ga, minlength=len(both)), np.bincount(gb, minlength=len(both))
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        segment = of_a[start_a] if len(both) else np.zeros(0, np.int64)  # no group crosses segments
        self.n_groups = np.bincount(segment, minlength=n)
        # exact in whole numbers; bincount's weights are not
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, segment, size_a * size_b)
        small = size_a * size_b <= LARGE_GROUP
        times = np.where(small[ga], size_b[ga], 0)
        link_a = np.repeat(fa, times)
        begin = np.cumsum(times) - times
        link_b = fb[np.repeat(start_b[ga], times) + np.arange(len(link_a)) - np.repeat(begin, times)]
        pairs, count, of = [(link_a << 32) | link_b], [np.ones(len(link_a), np.int64)], [np.repeat(of_a, times)]
        for g in np.flatnonzero(~small):
            ua, ka = np.unique(fa[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
            ub, kb = np.unique(fb[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
            pairs.append(((ua << 32)[:, None] | ub).ravel())
            count.append((ka[:, None] * kb).ravel())
            of.append(np.full(len(ua) * len(ub), segment[g]))
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable") if len(pairs) > 1 else slice(None)
        self.pairs, self.count = np.concatenate(pairs)[order], np.concatenate(count)[order]
        self.links = np.bincount(of, minlength=n)  # places of each segment in the flat array
        self.text = [""] * n
        if texts:
            # every id with the mark after it: , inside a side, | between sides, ; after a group
            last_a, last_b = np.r_[ga[1:] != ga[:-1], True] if len(ga) else [], np.r_[gb[1:] != gb[:-1], True] if len(gb) else []
            parts = [f"{i}{'|' if x else ','}" for i, x in zip(fa.tolist(), last_a, strict=True)] + [f"{i}{';' if x else ','}" for i, x in zip(fb.tolist(), last_b, strict=True)]
            place = np.argsort(np.r_[2 * ga, 2 * gb + 1], kind="stable").tolist()
            parts = [parts[i] for i in place]
            stop = np.cumsum(self.n_a + self.n_b).tolist()
            self.text = ["".join(parts[s:e]) for s, e in zip([0, *stop], stop)]


class Corpus:
    """Aligned segments of a task: a text is cut into segments, which are aligned once while they are kept."""

    FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def __init__(self, files: tuple[bytes, bytes], find=None, texts: bool = False):
        self.aligner, self.find, self.texts = Aligner(*files), find, texts
        self._fresh()

    def _fresh(self) -> None:
        self.place: dict[str, int] = {}
        self.room = 0
        self.ok = np.zeros(0, bool)
        self.figures = np.zeros((0, len(self.FIGURES)), np.int64)
        self.text: list[str] = []
        self.pairs, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self, keep: int) -> None:
        for s in list(self.place)[keep:]:
            del self.place[s]
        self.ok, self.figures, self.text = self.ok[:keep], self.figures[:keep], self.text[:keep]
        self.start, self.size = self.start[:keep], self.size[:keep]
        self.pairs = self.pairs[: int(self.start[-1] + self.size[-1])] if len(self.start) else self.pairs[:0]

    def _add(self, new: list[str]) -> None:
        new, *ids, ok = self.aligner.encode(new)
        got = Aligned(*ids, self.aligner, self.texts)
        self.room += sum(len(s) for s in new if len(s) > 40) + 8 * int(got.links[got.links > 60].sum())
        stop = np.cumsum(got.links)
        best = sums = np.zeros(len(new), np.int64)
        if self.find:
            flag, count = self.find(got.pairs)
            run = lambda x: np.diff(np.r_[0, np.r_[0, np.cumsum(x)][stop]])
            best, sums = run(flag * got.count), run(count * got.count)
        self.place.update(zip(new, range(len(self.ok), len(self.ok) + len(new)), strict=True))
        self.ok = np.r_[self.ok, ok]
        self.figures = np.r_[self.figures, np.c_[got.n_a, got.n_b, got.n_groups, got.n_links, best, sums]]
        self.text += got.text
        if not self.find:
            self.start = np.r_[self.start, len(self.pairs) + stop - got.links]
            self.size = np.r_[self.size, got.links]
            self.pairs = np.r_[self.pairs, got.pairs]

    def documents(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the numbers of its segments; None where it has no tokens by the rule."""
        if len(self.place) > CACHE_SEGMENTS:
            self._forget(CACHE_SEGMENTS // 2)
        cut = [CUT.split(t) if t else None for t in texts]
        for again in (False, True):
            if new := [s for s in set().union(*(c for c in cut if c)) if s not in self.place]:
                self._add(new)
            out = [np.fromiter(map(self.place.__getitem__, c), np.int64, len(c)) if c else None for c in cut]
            bad = [i for i, x in enumerate(out) if x is not None and not self.ok[x].all()]
            if again or not bad:
                break
            for i in bad:  # a text that has an odd segment is held against the rule as a whole
                cut[i] = [texts[i]]
        for i in bad:
            out[i] = None
        return out

    def trim(self) -> None:
        """A fresh start where few segments are so long that they take much room."""
        if self.room > 60 * BATCH_CHARS:
            self._fresh()

    def distinct_pairs(self, segments: np.ndarray) -> np.ndarray:
        u = _unique(segments)
        size = self.size[u]
        at = np.repeat(self.start[u] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return _unique(self.pairs[at])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts of rows, about ``BATCH_CHARS`` at once."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        at = size = 0
        held: list = []
        for i in range(len(texts)):
            held.append(texts[i].as_py())
            size += len(held[-1] or "")
            if size > BATCH_CHARS or i == len(texts) - 1:
                yield ids[at : i + 1], held
                at, size, held = i + 1, 0, []


def _pair_counts(src: DataFrame, files) -> DataFrame:
    """Rows (pair, h, n): pairs that some documents of a task hold linked, and how many; ``h`` deals pairs to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, held, size = None, [], 0
        counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged(done: bool):
            keys = np.concatenate([counts[0], *held])
            n = np.concatenate([counts[1], np.ones(len(keys) - len(counts[0]), np.int64)])
            u, inverse = np.unique(keys, return_inverse=True)
            total = np.zeros(len(u), np.int64)
            np.add.at(total, inverse, n)
            return u, total

        def sent():
            u, n = counts
            h = mix(u, 99)
            return pa.RecordBatch.from_pydict({"pair": pa.array(u), "h": pa.array(h.view(np.int64)), "n": pa.array(n)})

        for _, texts in _texts(batches):
            corpus = corpus or Corpus(files.value)
            for x in corpus.documents(texts):
                if x is not None:
                    held.append(corpus.distinct_pairs(x))
                    size += len(held[-1])
            corpus.trim()
            if size > HELD_PAIRS:
                counts, held, size = merged(False), [], 0
                if len(counts[0]) > HELD_PAIRS:
                    yield sent()
                    counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = merged(True)
        yield sent()

    return src.mapInArrow(run, "pair long, h long, n long")


def _shard(h, shards: int):
    """The shard of an unsigned 64-bit hash that is stored as a signed one."""
    return ((F.pmod(F.col(h), F.lit(shards)) + F.when(F.col(h) < 0, F.lit((1 << 64) % shards)).otherwise(0)) % shards).cast("int")


def _hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """Each shard's minimal perfect hash: (shard, sizes, bits, keys); a shard's keys are bounded by its even draw."""

    def run(batches):
        for b in batches:
            out = []
            for shard, keys in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sizes, bits, order = levels_of(np.sort(keys.values.to_numpy()))
                out.append({"shard": shard, "sizes": sizes, "bits": np.packbits(bits).tobytes(), "keys": order})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([o["shard"] for o in out], pa.int32()), "sizes": pa.array([o["sizes"] for o in out], pa.list_(pa.int32())), "bits": pa.array([o["bits"] for o in out], pa.binary()), "keys": pa.array([o["keys"] for o in out], pa.list_(pa.int64()))})

    keys = pairs.select("pair", _shard("h", shards).alias("shard")).distinct()
    return keys.groupBy("shard").agg(F.collect_list("pair").alias("keys")).mapInArrow(run, "shard int, sizes array<int>, bits binary, keys array<long>")


VECTORS = "shard int, salt int, vector array<long>"


def _vectors(pairs: DataFrame, shards: int, rows: list[dict]) -> DataFrame:
    """Count vectors (shard, salt, vector) of the block's shards: one of each task, indexed by the hash."""
    kept = pairs.sparkSession.sparkContext.broadcast([{k: r[k] for k in ("shard", "sizes", "bits", "keys")} for r in rows])  # at most a block's keys

    def run(batches):
        from pyspark import TaskContext

        table = PerfectHash(shards, kept.value)
        vector = np.zeros(len(table.keys), np.int64)
        for b in batches:
            at = table.find(b.column(0).to_numpy())
            if (at < 0).any():
                raise ValueError("a pair is not among the hash's keys")
            np.add.at(vector, at, b.column(1).to_numpy())
        start, out = 0, []
        for r in kept.value:
            part = vector[start : start + len(r["keys"])]
            start += len(r["keys"])
            if part.any():
                out.append((r["shard"], part))
        salt = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([o[0] for o in out], pa.int32()), "salt": pa.array([salt] * len(out), pa.int32()), "vector": pa.array([o[1] for o in out], pa.list_(pa.int64()))})

    shard = _shard("h", shards)
    return pairs.filter(shard.isin([r["shard"] for r in rows]) if len(rows) < shards else F.lit(True)).select("pair", "n").mapInArrow(run, VECTORS)


def _summed(vectors: DataFrame, salts: int) -> DataFrame:
    """One level of the tree: vectors of one shard and salt modulo ``salts`` are summed."""

    def run(batches):
        held: dict = {}

        def sent(keys):
            return pa.RecordBatch.from_pydict({"shard": pa.array([k[0] for k in keys], pa.int32()), "salt": pa.array([k[1] for k in keys], pa.int32()), "vector": pa.array([held.pop(k) for k in keys], pa.list_(pa.int64()))})

        for b in batches:
            for shard, salt, v in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2), strict=True):
                if held and (shard, salt) not in held:
                    yield sent(list(held))
                x = v.values.to_numpy()
                held[shard, salt] = held[shard, salt] + x if (shard, salt) in held else x
        if held:
            yield sent(list(held))

    key = ["shard", "salt"]
    return vectors.withColumn("salt", (F.col("salt") % salts).cast("int")).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, VECTORS)


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(src: DataFrame, files, kind: str, shards: int, rows: list[dict], best: dict[int, int]) -> DataFrame:
    """Figures of each document, with counts of the block's pairs: (id, the result's columns, hash of the text)."""
    kept = src.sparkSession.sparkContext.broadcast((rows, best))  # at most a block's keys, and a count for each id of one vocabulary
    schema = f"id {kind}, {RESULT}, h string"

    def run(batches):
        corpus = None
        for ids, texts in _texts(batches):
            if corpus is None:
                rows, best = kept.value
                table = PerfectHash(shards, rows)
                counts = np.concatenate([np.asarray(r["vector"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
                top = np.zeros(1 + max(best, default=0), np.int64)
                top[list(best)] = list(best.values())
                flags = (counts == top[table.keys >> 32]).astype(np.int64)

                def find(pairs, table=table, counts=counts, flags=flags):
                    at = table.find(pairs)
                    hit = at >= 0
                    out = np.zeros((2, len(pairs)), np.int64)
                    out[0, hit], out[1, hit] = flags[at[hit]], counts[at[hit]]
                    return out

                corpus = Corpus(files.value, find, texts=True)
            figures, sha = np.zeros((len(texts), len(Corpus.FIGURES)), np.int64), [""] * len(texts)
            for i, x in enumerate(corpus.documents(texts)):
                if x is not None:
                    figures[i] = corpus.figures[x].sum(axis=0)
                    sha[i] = hashlib.sha256("".join(map(corpus.text.__getitem__, x.tolist()))[:-1].encode()).hexdigest()
            corpus.trim()
            out = {"id": pa.array(ids, b_type)} | {c: pa.array(figures[:, k]) for k, c in enumerate(Corpus.FIGURES)} | {"groups_sha256": sha, "h": [hashlib.md5(t.encode()).hexdigest() if t is not None else None for t in texts] if several else [None] * len(texts)}
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    b_type, several = arrow.field("id").type, len(rows) < shards
    return src.mapInArrow(run, schema)


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, tokens of both vocabularies, groups, links, ``n_best`` (links whose count is the highest of
    their first id), ``count_sum`` (over links) and the SHA-256 of the groups.

    A pair's count is the number of documents that hold it linked. Null and empty texts, and those that a vocabulary does not give back
    byte for byte, have no tokens and zeros. Repeated rows are documents of their own; ids may be null or repeat; an empty table gives no
    rows. Only the two named columns are read. Pairs beyond ``BLOCK_KEYS`` take a further pass over the documents for each block;
    the passes' sums are joined by id and the text's hash."""
    spark = df.sparkSession
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))  # two vocabulary files of a few MB
    kind = df.select(id_col).schema[0].dataType.simpleString()
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    base = f"{shared_dir(spark)}/alignment-{uuid4().hex}"
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{base}/{name}")
    _pair_counts(src, files).write.parquet(f"{base}/pairs")
    pairs = read("pairs", "pair long, h long, n long")
    keys = pairs.select("pair").distinct().count()
    shards = max(1, -(-keys // SHARD_KEYS))
    _hashes(pairs, shards).write.parquet(f"{base}/hashes")
    hashes = read("hashes", "shard int, sizes array<int>, bits binary, keys array<long>")
    step = max(1, BLOCK_KEYS // SHARD_KEYS)
    blocks = [(s, min(s + step, shards)) for s in range(0, shards, step)]
    rows_of = lambda t, lo, hi: [r.asDict() for r in t.filter(F.col("shard").between(lo, hi - 1)).orderBy("shard").collect()]
    for k, (lo, hi) in enumerate(blocks):
        vectors = _vectors(pairs, shards, rows_of(hashes, lo, hi))
        for salts in (FAN_IN, 1):
            vectors = _summed(vectors, salts)
        vectors.join(hashes, "shard").select("shard", "sizes", "bits", "keys", "vector").write.parquet(f"{base}/counts/block={k}")
    counts = read("counts", "block int, shard int, sizes array<int>, bits binary, keys array<long>, vector array<long>")
    each = counts.select(F.explode(F.arrays_zip("keys", "vector")).alias("x")).groupBy(F.shiftright("x.keys", 32).cast("int").alias("a")).agg(F.max("x.vector").alias("n"))
    best = {r.a: r.n for r in each.collect()}  # one row an id of the vocabulary
    out = None
    for lo, hi in blocks:
        part = _looked_up(src, files, kind, shards, rows_of(counts, lo, hi), best)
        if out is None:
            out = part
            continue
        part = part.groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(F.max("n_best").alias("b2"), F.max("count_sum").alias("c2"))
        out = out.join(part, out.id.eqNullSafe(part.id2) & out.h.eqNullSafe(part.h2))
        out = out.withColumns({"n_best": F.col("n_best") + F.col("b2"), "count_sum": F.col("count_sum") + F.col("c2")}).drop("id2", "h2", "b2", "c2")
    drop_folder(spark, base)  # all that the result needs of it is in its broadcasts
    return out.drop("h").withColumnRenamed("id", id_col)
