"""Language identification, words first: known words count by their log frequency in each language, unseen ones by their
longest character n-grams that are known."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import arrow_map, drop_folder, shared_dir

#: Most (language, word) and (language, n-gram) counts of a model; each language has an equal share, its most frequent ones.
MAX_WORDS = 200_000
MAX_GRAMS = 200_000
#: Most languages of a model; of more, those of most documents.
MAX_LANGS = 1000
ORDERS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
#: Counts that a task holds before it sends them on.
HELD = 200_000
#: Word scores that a task keeps.
CACHE_CELLS = 2_000_000


#: Letters below U+0300, where no marks are: all of \\w but digits and other numbers.
_PLAIN = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, with the marks on them, in lower case."""
    if not text:
        return []
    text = text.lower()
    if max(text) < "\u0300":
        return _PLAIN.findall(text)
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between spaces."""
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def held_out(id_col) -> F.Column:
    """Whether the CRC-32 of the id, as text, leaves 1 by 3: such rows are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _summed(df: DataFrame, key: str, make) -> DataFrame:
    """Counts (lang, key, n) of what ``make`` gives for a row's columns: summed in tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def sent():
            rows = [(lang, k, n) for lang, c in held.items() for k, n in c.items()]
            held.clear()
            lang, k, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), key: pa.array(k, pa.string()), "n": pa.array(n, pa.int64())})

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    make(held.setdefault(row[0], Counter()), *row[1:])
                if sum(map(len, held.values())) > HELD:
                    yield from sent()
        yield from sent()

    return df.mapInArrow(run, f"lang string, {key} string, n long").groupBy("lang", key).agg(F.sum("n").alias("n"))


def _add_words(c: Counter, text: str) -> None:
    c.update(words_of(text))


def _add_grams(c: Counter, word: str, n: int) -> None:
    # a word counts by the binary digits of its frequency: unseen words are more like rare ones
    weight = n.bit_length()
    for k in ORDERS:
        for g in grams(word, k):
            c[g] += weight


def _kept(counts: DataFrame, key: str, most: int) -> tuple[list, dict]:
    """The most frequent counts of each language, at most ``most`` for all languages: those whose frequency class, an eighth of a
    power of two, has room with all classes above it. And the sums by language and length class (0 for words)."""
    order = F.when(F.lit(key == "gram"), F.length(key)).otherwise(0)
    t = counts.withColumns({"order": order, "class": F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")})
    sizes = t.groupBy("lang", "order", "class").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()  # at most 512 classes a language and order
    total: Counter = Counter()
    rows: dict[str, Counter] = {}
    for r in sizes:
        total[r.lang, r.order] += r.n
        rows.setdefault(r.lang, Counter())[r["class"]] += r.k
    share, least = most // max(1, len(rows)), {}
    for lang, c in rows.items():
        room, low = share, 1 << 30
        for k in sorted(c, reverse=True):
            room -= c[k]
            if room < 0:
                break
            low = k
        least[lang] = low
    if not least:
        return [], {}
    low = F.create_map(*(x for lang, k in least.items() for x in (F.lit(lang), F.lit(k))))
    got = t.filter(F.col("class") >= F.element_at(low, F.col("lang"))).select("lang", key, "n").toArrow()  # at most ``most`` rows
    return list(zip(*(c.to_pylist() for c in got.columns), strict=True)), dict(total)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_langs: int = MAX_LANGS) -> dict:
    """A model from all rows with a text and a language that are not held out. Its size is bounded by the three limits,
    whatever the size of ``df``; counts are over all rows."""
    spark = df.sparkSession
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    docs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    base = f"{shared_dir(spark)}/langid-{uuid4().hex}"
    try:
        _summed(rows.filter(F.col("lang").isin(*docs)) if docs else rows, "word", _add_words).write.parquet(f"{base}/words")
        words = spark.read.schema("lang string, word string, n long").parquet(f"{base}/words")
        _summed(words, "gram", _add_grams).write.parquet(f"{base}/grams")
        known, word_sums = _kept(words, "word", max_words)
        parts, gram_sums = _kept(spark.read.schema("lang string, gram string, n long").parquet(f"{base}/grams"), "gram", max_grams)
    finally:
        drop_folder(spark, base)
    return {"langs": sorted(docs), "docs": docs, "words": sorted(known), "word_sums": word_sums, "grams": sorted(parts), "gram_sums": gram_sums}


class Table:
    """Counts by key and language: the numbers of keys, and for each key its languages with what their counts add to the log
    frequency of an unseen one."""

    def __init__(self, rows: list, at: dict):
        self.place: dict[str, int] = {}
        keys = np.array([self.place.setdefault(key, len(self.place)) for _, key, _ in rows], np.int64)
        order = np.argsort(keys, kind="stable")
        self.lang = np.array([at[lang] for lang, _, _ in rows], np.int64)[order]
        self.more = np.log((np.array([n for *_, n in rows], float) + SMOOTH) / SMOOTH)[order]
        self.stop = np.cumsum(np.bincount(keys, minlength=len(self.place)))

    def sums(self, keys: np.ndarray, row: np.ndarray, n: int, langs: int) -> np.ndarray:
        """For each of ``n`` rows and each language the sum of what the row's keys add."""
        start = np.r_[0, self.stop][keys]
        size = self.stop[keys] - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(np.repeat(row, size) * langs + self.lang[at], self.more[at], n * langs).reshape(n, langs).astype(float)


class Scorer:
    """Scores of words by language, from the plain values that a broadcast carries."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        at = {x: i for i, x in enumerate(self.langs)}
        k = len(self.langs)
        total = sum(model["docs"].values())
        self.prior = np.log([model["docs"][x] / total for x in self.langs]) if k else np.zeros(0)
        self.words, self.grams = Table(model["words"], at), Table(model["grams"], at)
        size = Counter(map(len, self.grams.place))
        floors = {0: np.array([model["word_sums"].get((x, 0), 0) for x in self.langs]) + SMOOTH * max(1, len(self.words.place))}
        floors |= {n: np.array([model["gram_sums"].get((x, n), 0) for x in self.langs]) + SMOOTH * max(1, size[n]) for n in ORDERS}
        #: The log frequency of an unseen word, and of an unseen n-gram by its length.
        self.floors = {n: np.log(SMOOTH / x) for n, x in floors.items()}
        self.most = max(1000, CACHE_CELLS // max(1, k))
        self._fresh()

    def _fresh(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)))

    def _add(self, new: list[str]) -> None:
        """Scores of words: log frequencies of a known one; else the mean ones of its known n-grams of the greatest length that has
        any; else zeros."""
        k, know, look = len(self.langs), self.words.place, self.grams.place
        known, word, parts, part_of = [], [], [], []
        order, times = np.zeros(len(new), np.int64), np.ones(len(new))
        for i, w in enumerate(new):
            if (key := know.get(w)) is not None:
                known.append(key)
                word.append(i)
                continue
            order[i] = -1
            for n in ORDERS:
                if found := [g for x in grams(w, n) if (g := look.get(x)) is not None]:
                    parts += found
                    part_of += [i] * len(found)
                    order[i], times[i] = n, len(found)
                    break
        out = self.words.sums(np.array(known, np.int64), np.array(word, np.int64), len(new), k)
        out += self.grams.sums(np.array(parts, np.int64), np.array(part_of, np.int64), len(new), k) / times[:, None]
        for n, x in self.floors.items():
            out[order == n] += x
        self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        self.scores = np.r_[self.scores, out]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t) for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.place) > self.most:
            self._fresh()
        if new := [w for w in set().union(*found) if w not in self.place]:
            self._add(new)
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            got = self.scores[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0)
            got = got / np.sqrt(len(words)) + self.prior / len(words)  # neighbouring words are no independent evidence
            e = np.exp(got - got.max())
            best = int(np.argmax(got))
            out.append((self.langs[best], float(e[best] / e.sum())))
        return out


def identify(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, ``held_out``, ``lang_pred`` and its ``score`` (0 to 1).

    Only the text decides. A null text or one without a letter is ``und`` with score 0, as is all where nothing was learned. Texts
    of letters that no count knows get the most frequent language. Ties go to the language that sorts first; repeated rows give repeated
    rows, an empty table none; a null id is not held out. Only the two named columns are read."""
    kept = df.sparkSession.sparkContext.broadcast(model)  # bounded by the model's limits
    src = df.select(df[id_col].alias("id"), held_out(df[id_col]).alias("held"), df[text_col].alias("text"))
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def make():
        scorer = Scorer(kept.value)

        def f(id, held, text):
            got = scorer.predict(text)
            return {id_col: id, "held_out": held, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return f

    return arrow_map(src, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double", make)


def learn_and_identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``identify`` with a model of the rows of ``df`` that are not held out."""
    return identify(df, fit(df, id_col, text_col, lang_col), id_col, text_col)
