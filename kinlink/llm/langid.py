"""Language identification by words first, backing off to character n-grams.

Fit: words and character n-grams (4 to 1, of the word with its ends marked) are
counted per language on at most about ``PER_LANGUAGE`` labelled texts of each
language, drawn by a hash of doc_id.  All words and n-grams of that sample make
the model; it grows with the number of languages, not with the table.

Score: a word that the model knows adds its log frequency in every language; an
unseen word adds the mean log frequency of its longest n-grams that are known;
a word without any known n-gram adds nothing.  The prediction is the language
with the largest sum, ties by code point; its score is its share of the
exponentials of all sums.

Words are runs of letters (Unicode category L), lower-cased.  Words and n-grams are
64-bit hashes of their code points: texts are read as arrays, the model is sorted
arrays, and no word becomes an object.

Labels of rows whose crc32(doc_id as text) mod 4 is 2 are held out.  A prediction
looks at nothing but the text.

Defined results: a null text or one without a letter gives ``und`` and score 0;
so does any text when there are no labelled texts; bytes that aren't UTF-8 are no
letters; very long texts are read in pieces; a null doc_id counts as the empty text
in the hash; repeated rows stay; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.scratch import keeps_names, quoted, tables
from kinlink.llm.words import give_back, mix, tidy

GRAMS = (4, 3, 2, 1)
KINDS = (0, *GRAMS)
PER_LANGUAGE, ALPHA = 4000, 0.5
BENEFIT = 2
#: Entries that a task holds before it hands them on, and characters read at once.
FLUSH, PIECE = 1_000_000, 1 << 19
#: Texts that are decoded at once.
ROWS = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WEIGHTS = {n: mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95 + 2 * n)) | np.uint64(1) for n in GRAMS}
_OPEN, _CLOSE = ord("^"), ord("$")


@cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def runs(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``count[i]`` numbers from ``first[i]`` on, for all i in order."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _code_hash(code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


class Words:
    """The words of some lower-cased texts: code points, spans, texts, hashes."""

    def __init__(self, texts: list[str]):
        self.code = np.frombuffer("\0".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
        edge = np.flatnonzero(np.diff(letters()[self.code], prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")
        # A sum of hashes times powers, moved back to power 0: equal words, equal sums.
        sums = np.zeros(len(self.code) + 1, dtype=np.uint64)
        np.cumsum(_code_hash(self.code) * np.cumprod(np.full(len(self.code), _ODD)), out=sums[1:])
        back = np.cumprod(np.full(len(self.code) + 1, _BACK))
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start] + size)

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the words with these numbers, and whose they are."""
        inner = (self.end - self.start)[words]
        code, size = self.code[runs(inner, self.start[words])], inner
        if n > 1:  # with marks at both ends
            size = inner + 2
            marked = np.empty(int(size.sum()), dtype=np.uint32)
            at = np.cumsum(size) - size
            marked[at], marked[at + size - 1] = _OPEN, _CLOSE
            marked[runs(inner, at + 1)] = code
            code = marked
        many = np.maximum(size - n + 1, 0)
        at, out = runs(many, np.cumsum(size) - size), np.full(int(many.sum()), n, dtype=np.uint64)
        hashes = _code_hash(code)
        for k, w in enumerate(_WEIGHTS[n]):
            out += hashes[at + k] * w
        return mix(out), np.repeat(np.arange(len(words)), many)


def pieces(texts: Iterable[str | None], limit: int = PIECE) -> Iterator[tuple[np.ndarray, Words]]:
    """Texts by about ``limit`` characters: the numbers of the texts, and their words.

    A longer text is cut between words and comes in several pieces.
    """
    held, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        text = text.lower() if text else ""
        lo = 0
        while lo < len(text):
            hi = min(lo + limit, len(text))
            if hi < len(text):
                cut = hi
                while cut > lo and text[cut - 1].isalpha():
                    cut -= 1
                if cut == lo:  # one very long word
                    cut = hi
                    while cut < len(text) and text[cut].isalpha():
                        cut += 1
                hi = cut
            held.append(text[lo:hi])
            numbers.append(i)
            size += hi - lo
            lo = hi
            if size >= limit:
                yield np.array(numbers), Words(held)
                held, numbers, size = [], [], 0
    if held:
        yield np.array(numbers), Words(held)


def decoded(column: pa.Array) -> Iterator[str | None]:
    for x in column.cast(pa.binary()):
        yield x.as_py().decode("utf-8", "replace") if x.is_valid else None


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    entry, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return entry, np.bincount(number, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


@tidy
def count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, text -> lang, kind (0: word, n: n-gram), entry, count."""
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, kind), parts in held.items():
            entry, n = _counted(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(entry), dtype=np.int64))), pa.array(np.full(len(entry), kind, dtype=np.int32)), pa.array(entry.view(np.int64)), pa.array(n)],
                ["lang", "kind", "entry", "n"])
        held.clear()

    for b in batches:
        for lang in b.column(0).unique().to_pylist():
            mine = np.flatnonzero(np.asarray(pc.equal(b.column(0), lang)))
            for _, words in pieces(decoded(b.column(1).take(pa.array(mine)))):
                entry, first, times = np.unique(words.hash, return_index=True, return_counts=True)
                found = [(0, entry, times)]
                for n in GRAMS:
                    hashes, owner = words.grams(first, n)
                    found.append((n, *_counted([(hashes, times[owner])])))
                for kind, e, n in found:
                    held.setdefault((lang, kind), []).append((e, n))
                    size += len(e)
            if size > FLUSH:
                yield from flush()
                size = 0
    yield from flush()


class Model:
    """Log frequencies by language: for each kind sorted entries and a matrix."""

    def __init__(self, rows: Iterable[tuple[str, int, str, int]]):
        """From rows (language, kind, word or n-gram, count)."""
        rows = list(rows)
        entry = [Words([r[2]]).hash[0] if r[1] == 0 else self._gram(r[2]) for r in rows]
        langs = sorted({r[0] for r in rows})
        self._fill(langs, np.array([langs.index(r[0]) for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int32), np.array(entry, dtype=np.uint64), np.array([r[3] for r in rows], dtype=np.int64))

    @staticmethod
    def _gram(text: str) -> np.uint64:
        hashes = _code_hash(np.array([ord(c) for c in text]))
        return mix(np.array([len(text)], dtype=np.uint64) + (hashes * _WEIGHTS[len(text)]).sum(dtype=np.uint64))[0]

    @classmethod
    def of(cls, table: pa.Table) -> Model:
        """From columns lang, kind, entry, n, as ``count_texts`` makes them."""
        out = cls.__new__(cls)
        lang = table["lang"].cast(pa.string()).combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
        names = lang.dictionary.to_pylist()
        place = np.argsort(np.argsort(np.array(names, dtype=object))) if names else np.zeros(0, dtype=np.int64)
        out._fill(sorted(names), place[lang.indices.to_numpy(zero_copy_only=False)], table["kind"].to_numpy(), table["entry"].to_numpy().view(np.uint64), table["n"].to_numpy())
        return out

    def _fill(self, langs: list[str], column: np.ndarray, kind: np.ndarray, entry: np.ndarray, n: np.ndarray) -> None:
        self.langs, self.keys, self.logs = langs, {}, {}
        for k in KINDS:
            mine = np.flatnonzero(kind == k)
            self.keys[k], row = np.unique(entry[mine], return_inverse=True)
            m = np.zeros((len(self.keys[k]), len(self.langs)))
            np.add.at(m, (row, column[mine]), n[mine])
            self.logs[k] = np.log((m + ALPHA) / (m.sum(axis=0) + ALPHA * max(1, len(m)))).astype(np.float32)

    def find(self, kind: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the entries that are known, and their rows."""
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, entry), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == entry)
        return hit, at[hit]

    def _word_scores(self, words: Words, entry: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One row for each distinct word: its scores in all languages; and how much of it
        is known: 1 for a known word, else the known share of its longest n-grams."""
        out, known = np.zeros((len(entry), len(self.langs))), np.zeros(len(entry))
        hit, row = self.find(0, entry)
        out[hit], known[hit] = self.logs[0][row], 1.0
        unseen = np.setdiff1d(np.arange(len(entry)), hit, assume_unique=True)
        for n in GRAMS:
            if not len(unseen):
                break
            gram, whole = words.grams(first[unseen], n)
            hit, row = self.find(n, gram)
            owner = whole[hit]
            many = np.bincount(owner, minlength=len(unseen))
            if n == GRAMS[0]:
                known[unseen] = many / np.maximum(1, np.bincount(whole, minlength=len(unseen)))
            some = np.flatnonzero(many)
            for k in range(len(self.langs)):
                out[unseen[some], k] = np.bincount(owner, weights=self.logs[n][row, k], minlength=len(unseen))[some] / many[some]
            unseen = unseen[many == 0]
        return out, known

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """The language of each text and its score."""
        for lang, score, _ in self.judge(texts):
            yield lang, score

    def judge(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, float]]:
        """As ``predict``, and the share of the text's words that the model knows, in which
        ``BENEFIT`` further words count as known: little text is little evidence."""
        texts = list(texts)
        total, n, sure = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        if self.langs:
            for number, words in pieces(texts):
                entry, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
                (scores, known), owner = self._word_scores(words, entry, first), number[words.text]
                n += np.bincount(owner, minlength=len(texts))
                sure += np.bincount(owner, weights=known[place], minlength=len(texts))
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(owner, weights=scores[place, k], minlength=len(texts))
        best = total.argmax(axis=1) if self.langs else n
        for i, (k, some) in enumerate(zip(best.tolist(), n.tolist())):
            if some:
                yield self.langs[k], 1.0 / float(np.exp(np.maximum(total[i] - total[i, k], -700.0)).sum()), (sure[i] + BENEFIT) / (some + BENEFIT)
            else:
                yield "und", 0.0, 0.0


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.join(F.broadcast(sizes), "lang").filter(draw * F.col("n") < per_language).select("lang", "text")
    # The sample is bounded, so it can be spread: one file would be one task.
    spread = sample.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    counted = spread.mapInArrow(count_texts, "lang string, kind int, entry bigint, n bigint").groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))
    model = Model.of(counted.toArrow())
    give_back()
    return model


@keeps_names
def predict(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (text, ...) with the prediction and its score as last columns, and under a
    third name the share that is known (see ``Model.judge``).

    The model travels with the function, which Spark broadcasts.
    """
    place = docs.columns.index("text")
    made = {n.lower() for n in names}
    where = [i for i, c in enumerate(docs.columns) if c.lower() not in made]
    kept = [docs.columns[i] for i in where]
    schema = ", ".join(f"{quoted(c)} {t}" for c, t in (docs.dtypes[i] for i in where)) + (", " if where else "") + ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "double", "double")))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A few texts at a time: a batch may hold 64 MB of them.
            parts = (b.column(place).slice(lo, ROWS) for lo in range(0, b.num_rows, ROWS))
            got = [g for part in parts for g in model.judge(decoded(part))]
            more = [pa.array([g[k] for g in got], pa.float64() if k else pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in where] + more, kept + list(names))

    return docs.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = predict(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs))
    return got.select("doc_id", "held_out", "lang_pred", "score")
