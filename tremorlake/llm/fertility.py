"""Quality rules from tokeniser fertility: characters per token, byte-fallback share and token entropy.

Every word is encoded by itself under each of some public vocabularies. A text is rejected where a measure
falls out of the band of its language (or script) under any of them. Bands come from the table itself: the
median of all texts of a language that pass the base rules, less or more ``SPREAD`` times the distance of its
quartiles; languages and scripts of too few texts have the fixed bands below.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremorlake.llm.common import small_batches, written
from tremorlake.llm.substrings import rolling

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\v\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Texts measured at once in a task, and their bytes together; a longer text is measured by itself.
TEXTS, TEXT_BYTES = 128, 1 << 20
#: Words whose tokens a worker keeps; the cache starts anew beyond it.
CACHE_WORDS = 50_000

#: Bands that are broadcast at most.
BROADCAST_BANDS = 10_000
#: Texts that a language or script needs for a band of its own.
MIN_TEXTS = 100
#: How far a band reaches beyond the median, in distances of the quartiles.
SPREAD = 3.0
#: Bands are wider by these over the square root of the number of words, as short texts scatter more.
SLACK = {"chars": 1.2, "bytes": 0.6, "entropy": 0.6}

#: Fixed bands by language or script: least and most characters a token, most byte-fallback share, least token entropy as a
#: share of the entropy of as many different tokens. English prose has over 4 characters
#: a token, that of other languages in Latin script over 2.5.
BANDS = {
    "en": (3.2, 8.0, 0.05, 0.46),
    "latin": (2.4, 8.0, 0.10, 0.46),
    "cyrillic": (1.2, 8.0, 0.10, 0.46),
    "greek": (0.8, 8.0, 0.20, 0.46),
    "cjk": (0.3, 3.0, 0.80, 0.40),
    "other": (0.2, 8.0, 0.50, 0.40),
}
# First code points of runs of scripts beyond ASCII.
SCRIPTS = ((0x80, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"), (0x32000, "other"))
_STARTS = np.array([a for a, _ in SCRIPTS])


def script_of(text: str) -> str:
    """The script of most letters; a text without letters is ``latin``."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    far = points[points >= 0x80]
    tally = {"latin": len(points) - len(far) - int(np.count_nonzero((points < 0x41) | ((points > 0x5A) & (points < 0x61)) | ((points > 0x7A) & (points < 0x80))))}
    for k, n in enumerate(np.bincount(np.searchsorted(_STARTS, far, "right") - 1, minlength=len(SCRIPTS)).tolist()):
        if n:
            tally[SCRIPTS[k][1]] = tally.get(SCRIPTS[k][1], 0) + n
    tally.pop("none", None)
    return max(tally, key=lambda s: (tally[s], s == "latin"))


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """For each text, the words in windows of ``width`` words that it has at least twice; ``codes`` number the words
    of all texts in a row, ``doc`` tells their texts. Windows of equal hashes are compared by words."""
    n = len(codes) - width + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    start = np.flatnonzero(doc[:n] == doc[width - 1 :])
    label = rolling((codes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), width)[start] + doc[start].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(label, kind="stable")
    same = label[order[1:]] == label[order[:-1]]
    edge = np.zeros(len(codes) + 1, np.int64)
    some = start[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else start
    if len(some):
        rows = np.c_[doc[some], codes[some[:, None] + np.arange(width)]].astype(">u4")
        by_words = np.argsort(rows.view(f"S{4 * (width + 1)}").ravel(), kind="stable")
        equal = (rows[by_words][1:] == rows[by_words][:-1]).all(axis=1)
        twice = some[by_words[np.r_[False, equal] | np.r_[equal, False]]]
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + width, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


class Vocabulary:
    """A public vocabulary by its file's kind: a sentencepiece model with byte fallback, or ranks of byte-level BPE,
    where words follow a space and a lone byte of a longer character counts as byte fallback."""

    def __init__(self, name: str, raw: bytes):
        if name.endswith(".tiktoken"):
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            self.one = tiktoken.Encoding("own", pat_str=r" ?\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.is_byte[[i for t, i in ranks.items() if len(t) == 1 and t[0] >= 0x80]] = True
        else:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.one = None
            self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self.one(f" {w}") for w in words] if self.one else self.sp.encode(words, num_threads=1)


class Fertility:
    """The measures of many texts at once: their words lie in one flat array, each different word is encoded once."""

    def __init__(self, vocabs: list[tuple[str, bytes]]):
        self.vocabs = [Vocabulary(n, r) for n, r in vocabs]
        self.cache: dict[str, tuple[list[int], ...]] = {}

    def tokens(self, words: list[str]) -> list[tuple[list[int], ...]]:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        if new := [w for w in words if w not in self.cache]:
            self.cache.update(zip(new, zip(*(v.encode(new) for v in self.vocabs), strict=True), strict=True))
        return [self.cache[w] for w in words]

    def columns(self, texts: list[str | None]) -> dict[str, list]:
        texts = [t or "" for t in texts]
        split = [b" ".join(t.encode("utf-8", "surrogatepass").split()) for t in texts]
        n_words = np.array([s.count(b" ") + 1 if s else 0 for s in split], np.int64)
        doc = np.repeat(np.arange(len(texts)), n_words)
        coded = pc.split_pattern(pa.array([b" ".join(filter(None, split))], pa.large_binary()), pattern=" ").values.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[: len(doc)]
        words = [w.decode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
        n_repeat = repeated_words(codes, doc, len(texts))
        # each different word of a text once, with how often it stands there
        pair, times = np.unique(doc * len(words) + codes, return_counts=True)
        pair_doc, pair_word = pair // len(words), pair % len(words)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.bincount(pair_doc, letters[pair_word] * times, len(texts))
        out = {
            "n_words": n_words,
            "word_chars": [len(t) - sum(map(t.count, SEPARATORS)) for t in texts],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [self._dup_lines(t) for t in texts],
            "n_repeat_words": n_repeat,
            "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words),
            "script": [script_of(t) for t in texts],
        }
        got = self.tokens(words) if len(doc) else []
        for k, v in enumerate(self.vocabs):
            each = [g[k] for g in got]
            size = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter(chain.from_iterable(each), np.int64, int(size.sum()))
            many = size[pair_word]
            begin = np.cumsum(size) - size
            token = flat[np.repeat(begin[pair_word] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())] if len(pair) else flat
            weight, of = np.repeat(times, many), np.repeat(pair_doc, many)
            n = np.bincount(of, weight, len(texts))
            # the entropy of a text's tokens from the counts of its different tokens
            key, where = np.unique(of * len(v.is_byte) + token, return_inverse=True)
            count = np.bincount(where, weight, len(key))
            key_doc = key // len(v.is_byte)
            share = count / n[key_doc]
            entropy = np.bincount(key_doc, -share * np.log2(share), len(texts)) + 0.0
            with np.errstate(invalid="ignore", divide="ignore"):
                per_token = np.where(n > 0, chars / n, np.nan)
                bytes_ = np.where(n > 0, np.bincount(of, weight * v.is_byte[token], len(texts)) / n, 0.0)
            out[f"n_tokens_{k}"] = n.astype(np.int64)
            out[f"chars_per_token_{k}"] = pa.array(per_token, from_pandas=True)
            out[f"byte_share_{k}"] = bytes_
            out[f"token_entropy_{k}"] = entropy
        return out

    @staticmethod
    def _dup_lines(text: str) -> int:
        lines = [x for x in text.split("\n") if x.strip(SEPARATORS)] if "\n" in text else []
        return len(lines) - len(set(lines))


def parts(column: pa.Array) -> list[tuple[int, int]]:
    """Runs of rows (first, number) of at most ``TEXTS`` texts and, but for runs of one, ``TEXT_BYTES`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == TEXTS or held + n > TEXT_BYTES):
            out.append((start, i - start))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes) - start)] if sizes else out


def _schema(n_vocabs: int) -> str:
    return "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string" + "".join(f", n_tokens_{k} long, chars_per_token_{k} double, byte_share_{k} double, token_entropy_{k} double" for k in range(n_vocabs))


def _measured(df: DataFrame, paths: list[str], text_col: str) -> DataFrame:
    """``df`` with the measures of each row; names that clash get theirs after ``_m_``."""
    raw = []
    for p in paths:
        with open(p, "rb") as f:
            raw.append((p, f.read()))
    vocabs = df.sparkSession.sparkContext.broadcast(raw)
    added = T.StructType([T.StructField(f"_m_{f.name}", f.dataType) for f in T.StructType.fromDDL(_schema(len(paths)))])
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow, at = to_arrow_schema(added), df.columns.index(text_col)

    def run(batches):
        f = None
        for batch in batches:
            f = f or Fertility(vocabs.value)
            for a, n in parts(batch.column(at)):
                part = batch.slice(a, n)
                got = f.columns(part.column(at).to_pylist())
                cols = [got[n.name[3:]] for n in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns, *(c if isinstance(c, pa.Array) else pa.array(c, n.type) for c, n in zip(cols, arrow, strict=True))], names=[*part.schema.names, *arrow.names])

    return df.mapInArrow(run, schema)


def _entropy_share(k: int) -> Column:
    """Token entropy as a share of the entropy of as many different tokens, at most 4,096."""
    return F.col(f"_m_token_entropy_{k}") / F.log2(F.least(F.greatest(F.col(f"_m_n_tokens_{k}"), F.lit(2)), F.lit(4096)))


def _small(bands: DataFrame) -> DataFrame:
    """Bands as a broadcast table where they are ``BROADCAST_BANDS`` at most, as languages and scripts are; else as they are."""
    got = bands.limit(BROADCAST_BANDS + 1).collect()
    return F.broadcast(bands.sparkSession.createDataFrame(got, bands.schema)) if len(got) <= BROADCAST_BANDS else bands


def _judged(rows: DataFrame, n_vocabs: int, lang: Column, bands: dict | None) -> DataFrame:
    """``rows`` with ``_m_reasons``, from bands by language, else by script, else from the fixed table."""
    rows = rows.withColumn("_m_lang", lang.cast("string"))
    names = ["chars", "bytes", "entropy"]
    measure = {(n, k): c for k in range(n_vocabs) for n, c in zip(names, (F.col(f"_m_chars_per_token_{k}"), F.col(f"_m_byte_share_{k}"), _entropy_share(k)), strict=True)}
    if bands is None:
        # exact quartiles over all rows; values of three digits keep their counts small
        stats = lambda by: rows.filter(~F.col("_m_base_failed") & F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(F.round(c, 3), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"{n}{k}") for (n, k), c in measure.items())).filter(F.col("n") >= MIN_TEXTS).select(by, F.struct(*(f"{n}{k}" for n, k in measure)).alias(f"{by}_band"))
        for by in ("_m_lang", "_m_script"):
            rows = rows.join(_small(stats(by)), by, "left")
        rows = rows.withColumn("_m_band", F.coalesce("_m_lang_band", "_m_script_band"))
    fixed = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, map(float, v)))) for k, v in (bands or BANDS).items()))
    at = lambda i: F.coalesce(F.try_element_at(fixed, F.col("_m_lang"))[i], F.try_element_at(fixed, F.col("_m_script"))[i])
    root = F.sqrt(F.greatest(F.col("_m_n_words"), F.lit(1)))

    def edge(n: str, k: int, side: int, given: Column) -> Column:
        own = lambda: F.col("_m_band")[f"{n}{k}"]
        learned = F.lit(None) if bands is not None else own()[1] + side * SPREAD * (own()[2] - own()[0])
        # a language whose texts are all alike gets no band of no width
        least = {"chars": 0.02, "bytes": 0.01, "entropy": 0.01}[n]
        return F.coalesce(learned + side * least, given) + side * SLACK[n] / root

    def out(test) -> Column:
        return reduce(lambda a, b: a | b, (F.coalesce(test(k), F.lit(False)) for k in range(n_vocabs)))

    low = out(lambda k: measure["chars", k] < edge("chars", k, -1, at(0)))
    high = out(lambda k: measure["chars", k] > edge("chars", k, 1, at(1)))
    fallback = out(lambda k: measure["bytes", k] > edge("bytes", k, 1, at(2)))
    poor = out(lambda k: measure["entropy", k] < edge("entropy", k, -1, at(3)))
    reasons = F.concat_ws(",", F.when(F.col("_m_base_failed"), "base"), F.when(low | high, "chars_per_token"), F.when(fallback, "byte_fallback"), F.when(poor, "token_entropy"))
    return rows.withColumn("_m_reasons", reasons)


def _paths(vocab_paths: str | list[str]) -> list[str]:
    return [vocab_paths] if isinstance(vocab_paths, str) else list(vocab_paths)


def measure(df: DataFrame, vocab_paths: str | list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict | None = None) -> DataFrame:
    """One row for each row of ``df``: its id, the base counts, the fertility measures by vocabulary and the verdict.

    Characters a token (null without words) fall where words carry junk symbols, odd capitals or separators, byte
    fallback rises in unknown scripts, and token entropy falls in repetition. ``bands`` by language or
    script replace those of the table. A null text counts as empty: no words, base_failed. A null language
    goes by the script. Repeated rows give repeated rows, an empty table none; other columns are not
    read. Measures are written once to the shared folder, as bands need all of them.
    """
    paths = _paths(vocab_paths)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"), (df[lang_col] if lang_col else F.lit(None)).cast("string").alias("lang"))
    with small_batches(df.sparkSession):
        rows = written(_measured(src, paths, "text").drop("text"))
    rows = _judged(rows, len(paths), F.col("lang"), bands)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    more = [f"{c}_{k}" for k in range(len(paths)) for c in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")]
    return rows.select(F.col("id").alias(id_col), *(F.col(f"_m_{c}").alias(c) for c in base), (F.col("_m_reasons") == "").alias("kept"), *(F.col(f"_m_{c}").alias(c) for c in more), F.col("_m_script").alias("script"), F.col("_m_reasons").alias("reasons"))


def keep_good(df: DataFrame, vocab_paths: str | list[str], text_col: str = "text", lang_col: str | None = "lang", bands: dict | None = None) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all their columns; null and empty texts go. Rows are measured once and
    written with their measures to the shared folder; columns that begin with ``_m_`` are left out."""
    paths = _paths(vocab_paths)
    df = df.select(*(c for c in df.columns if not c.startswith("_m_")))
    with small_batches(df.sparkSession):
        rows = written(_measured(df, paths, text_col))
    rows = _judged(rows, len(paths), F.col(lang_col) if lang_col else F.lit(None), bands)
    return rows.filter(F.col("_m_reasons") == "").select(*df.columns)
