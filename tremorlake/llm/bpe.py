"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from tremorlake.llm.common import arrow_map

#: Words whose ids a worker keeps; the cache starts anew beyond it.
CACHE_WORDS = 200_000
#: Words longer than this are merged each time, not kept.
CACHE_CHARS = 64
NONE = np.int64(1) << 40
# Ranges of letters and digits that Unicode 17 added.
UNICODE_17 = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CF, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# Small forms of capitals of Unicode 16 and 17, and sigma, which has one form where letters change one by one.
SMALL = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 bytes stand for
    themselves, the others for the letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _latin(text: str) -> bool:
    """Whether a text is of Latin-1, which is in NFC and has plain small forms."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBpe:
    """Encoder for a vocabulary file of word-end BPE: ids of texts, and texts of ids.

    ``spec`` is the file's parsed JSON. A text is cut at special tokens; the rest is put in NFC,
    letters become small one by one, and words are found by
    the file's pattern. Each word's bytes are symbols, the last with the word-end suffix."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = [""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for t, i in [*self.vocab.items(), *special.items()]:
            self.tokens[i] = t
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        # Letters and digits of Unicode 17 count as symbols, as in the library.
        late = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNICODE_17)
        self.late = regex.compile(f"[{late}]")
        for kind, rest in ((r"[\p{L}]", rf"[\p{{L}}--[{late}]]"), (r"[\p{N}]", rf"[\p{{N}}--[{late}]]"), (r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]")):
            pattern = pattern.replace(kind, rest)
        self.late_pattern = pattern
        self.late_words = None
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + suffix] for c in letters], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        key = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers.

        All words lie in one flat array. In a round, binary search over the sorted pair keys gives
        every neighbouring pair its rank, each word takes its lowest, and all its occurrences
        merge from the left; words without a pair that merges leave the array."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        while len(sym):
            pair = (sym[:-1] << 20) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(sym), NONE)
            ok = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][ok] = self.ranks[at[ok]]
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            done = best == NONE
            if done.any():
                flat = sym.astype("<u4").tobytes()
                for k in np.flatnonzero(done):
                    out[word[start[k]]] = flat[4 * start[k] : 4 * (start[k] + length[k])]
                live = np.repeat(~done, length)
                sym, word, rank = sym[live], word[live], rank[live]
                best, length = best[~done], length[~done]
                if not len(sym):
                    break
            hit = (rank == np.repeat(best, length)) & (rank < NONE)
            i = np.flatnonzero(hit)
            # in a run of overlapping occurrences every other one merges
            first = np.r_[True, np.diff(i) != 1]
            i = i[(i - i[first][np.cumsum(first) - 1]) % 2 == 0]
            sym[i] = self.merged[rank[i]]
            stay = np.ones(len(sym), bool)
            stay[i + 1] = False
            sym, word = sym[stay], word[stay]
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        find = self.words
        if not _latin(text) and not _latin(text := unicodedata.normalize("NFC", text)):
            text = text.translate(SMALL)
            if self.late.search(text):
                import regex

                self.late_words = self.late_words or regex.compile(self.late_pattern, regex.V1).findall
                find = self.late_words
        # no word holds white space, so runs of it need not be made one
        return find(text.lower())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        found: list[list] = []
        for t in texts:
            if self.cut and "<|" in t and len(parts := self.cut.split(t)) > 1:
                row: list = []
                for k, p in enumerate(parts):
                    row += [self.special[p]] if k % 2 else self.pieces(p)
                found.append(row)
            else:
                found.append(self.pieces(t))
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        new = [w for w in set().union(*found) if w not in cache and isinstance(w, str)]
        got = dict(zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new]), strict=True)) if new else {}
        got |= {i: int(i).to_bytes(4, "little") for i in self.special.values()}
        cache.update((w, b) for w, b in got.items() if isinstance(w, int) or len(w) <= CACHE_CHARS)
        look = cache if all(w in cache for w in new) else cache | got
        return [b"".join(map(look.__getitem__, row)) for row in found]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_tokens``, ``ids`` (array<int>, if ``keep_ids``), and the
    SHA-256 of the ids and of the decoded text.

    The vocabulary, a file of a few MB on the driver, is broadcast. A null text counts as empty
    and has no tokens; repeated rows give repeated rows, an empty table none. Only the two named
    columns are read, so other columns may have any name.
    """
    spec = df.sparkSession.sparkContext.broadcast(load_spec(vocab_path))
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def make():
        bpe = WordBpe(spec.value)

        def f(id, text):
            rows = bpe.encode_batch([t or "" for t in text])
            out = {id_col: id, "n_tokens": [len(r) // 4 for r in rows], "ids_sha256": [hashlib.sha256(r).hexdigest() for r in rows], "decoded_sha256": [hashlib.sha256(bpe.decode(r).encode("utf-8", "surrogatepass")).hexdigest() for r in rows]}
            return out | ({"ids": [np.frombuffer(r, "<u4").astype(np.int32) for r in rows]} if keep_ids else {})

        return f

    return arrow_map(src, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, make)
