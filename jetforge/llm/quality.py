"""Quality rules: repetition, and divergence from language references.

A document's character classes and common words are compared with those of its language in the
whole corpus by the Jensen-Shannon distance. Which words are common is counted too: there are no
word lists, and a language is whatever the documents name as one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_of, quoted, renamed, stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8  # words
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.12  # Jensen-Shannon distance (base 2, 0 to 1) beyond chance
CLASS_CHARS, WORD_WORDS = 200, 60  # documents below are too short for the comparison

COMMON = 24  # most frequent words of a language that are compared
MIN_DOCS = 20  # documents of a language below which only the base rule holds
SUMMARY = 4096  # counters a task keeps of a language: a word with more than one in so many is never lost

# Fixed value: the symbols of the base rule.
SYMBOLS = "#*$%&|<>"
_EDGES = b".,;:!?\"'()[]#*$%&|<>-"


def _classes() -> np.ndarray:
    """Byte to character class: lower case, upper case, digit, white space, sentence mark, other
    ASCII, first byte of a character beyond ASCII; later bytes of one have none."""
    out = np.zeros((256, 7), np.int64)
    for b in range(256):
        c = chr(b)
        if b < 128:
            k = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:?'\"()-" else 5
            out[b, k] = 1
        elif b >= 0xC0:
            out[b, 6] = 1
    return out


_CLASSES = _classes()
N_CLASSES = _CLASSES.shape[1]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice. Windows are ranked exactly by doubling:
    ranks of pairs, of pairs of pairs, and so on."""
    n = len(ids)
    if n <= window:
        return 0
    rank, step = ids, 1
    while step < window:
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    at = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def plain_word(word: bytes) -> bytes:
    return word.lower().strip(_EDGES)


def measure(text: bytes, common_words: dict[bytes, int]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, word counts (of
    the language's common words, then of all others)."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    word_chars = sum(map(len, words)) - int(seen[0x80:0xC0].sum())
    symbols = int(seen[[ord(c) for c in SYMBOLS]].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    repeats = repeated_words(ids) if len(number) < len(words) else 0
    common = np.zeros(len(common_words) + 1, np.int64)
    times = np.bincount(ids, minlength=len(number)).tolist()
    for w, n in zip(number, times):
        k = common_words.get(plain_word(w))
        if k is not None:
            common[k] += n
    common[-1] = len(words) - int(common.sum())
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeats, seen @ _CLASSES, common


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0)))


def chance(n: int, bins: int) -> float:
    """Distance that ``n`` draws from the reference itself have on average, to first order."""
    return float(np.sqrt((bins - 1) / (8 * np.log(2) * n))) if n else 1.0


def divergence(classes: np.ndarray, common: np.ndarray, lang: str | None, references: dict) -> tuple[float, float]:
    """Distances of the classes and of the common words from the language's reference; 0 without
    one, and for documents below the minimum length. What chance would give at the document's
    length is taken off: short texts scatter more."""
    if lang not in references:
        return 0.0, 0.0
    of_classes, of_words = references[lang]
    chars, words = int(classes.sum()), int(common.sum())
    by_class = distance(classes, of_classes) - chance(chars, N_CLASSES) if chars >= CLASS_CHARS else 0.0
    by_word = distance(common, of_words) - chance(words, len(common)) if words >= WORD_WORDS else 0.0
    return max(by_class, 0.0), max(by_word, 0.0)


def _reduced(counts: Counter) -> Counter:
    """The most frequent SUMMARY words, each count less that of the first word left out: a count is
    never too high, and too low by one in SUMMARY of all words at most."""
    if len(counts) <= SUMMARY:
        return counts
    floor = sorted(counts.values(), reverse=True)[SUMMARY]
    return Counter({w: n - floor for w, n in counts.items() if n > floor})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: documents and frequent words of each language."""
    words, docs = defaultdict(Counter), Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = (text.as_py() or b"").split()
            if len(found) < MIN_WORDS:
                continue
            docs[lang] += 1
            words[lang].update(found)
            if len(words[lang]) > 16 * SUMMARY:
                words[lang] = _reduced(words[lang])
    rows = [(k, None, n) for k, n in docs.items()]
    for k, counts in words.items():
        plain: Counter = Counter()
        for w, n in _reduced(counts).items():
            plain[plain_word(w).decode("utf-8", "replace")] += n
        rows += [(k, w, n) for w, n in plain.items() if w]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                                     names=["lang", "word", "n"])


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[bytes, int]]:
    """The COMMON most frequent words of each language with MIN_DOCS documents of MIN_WORDS words,
    numbered. What reaches the driver is COMMON rows for each such language."""
    thin = docs.where(quoted(lang_col).isNotNull()).select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("binary").alias("text"))
    counts = stored(thin.mapInArrow(_frequent, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "frequent-words")
    large = counts.where(F.col("word").isNull() & (F.col("n") >= MIN_DOCS)).select("lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.where(F.col("word").isNotNull()).join(large, "lang").withColumn("place", place).where(F.col("place") <= COMMON)
    out: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in top.select("lang", "word", "place").collect():
        out[r["lang"]][r["word"].encode()] = r["place"] - 1
    return {k: {w: i for i, w in enumerate(sorted(v, key=v.get))} for k, v in out.items()}


def _measured(words: dict[str, dict[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            langs = batch.column(batch.num_columns - 2).to_pylist()
            got = [measure(t.as_py() or b"", words.get(k, {})) for t, k in zip(batch.column(batch.num_columns - 1), langs)]
            columns = [pa.array([g[k] for g in got], pa.int64()) for k in range(5)]
            columns += [pa.array([g[k].tolist() for g in got], pa.list_(pa.int64())) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names, "_classes", "_common"])
    return run


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, _classes array<long>, _common array<long>"


def _texts(docs: DataFrame, id_cols: tuple[str, ...], text_col: str, lang_col: str) -> tuple[DataFrame, str]:
    thin = docs.select(*ids_of(docs, id_cols), quoted(lang_col).cast("string").alias("_lang"), quoted(text_col).cast("binary").alias("_text"))
    return thin, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema.fields[:-1])


def _language_sums(sizes: dict[str, int]):
    """Task side: sums of the histograms of documents that pass the base rule, by language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(N_CLASSES + n + 1, np.int64) for k, n in sizes.items()}
        for batch in batches:
            n, repeat, lang, classes, common = (batch.column(i).to_pylist() for i in range(5))
            for i, k in enumerate(lang):
                if k in sums and not base_failed(n[i], repeat[i]):
                    sums[k] += np.concatenate([classes[i], common[i]])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])
    return run


def references_of(measured: DataFrame, words: dict[str, dict[bytes, int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and common-word counts of each language over all documents: a few dozen numbers each."""
    sizes = {k: len(v) for k, v in words.items()}
    rows = measured.select("n_words", "n_repeat_words", "_lang", "_classes", "_common").mapInArrow(_language_sums(sizes), "lang string, sums array<long>")
    flat = rows.select("lang", F.posexplode("sums").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n"))
    sums = {k: np.zeros(N_CLASSES + n + 1, np.int64) for k, n in sizes.items()}
    for lang, k, n in flat.collect():
        sums[lang][k] = n
    return {k: (x[:N_CLASSES], x[N_CLASSES:]) for k, x in sums.items() if x.sum()}


def _verdict(n_words: int, repeat: int, lang: str | None, classes: np.ndarray, common: np.ndarray, references: dict) -> tuple[bool, float, float, bool]:
    failed = base_failed(n_words, repeat)
    by_class, by_word = divergence(classes, common, lang, references)
    return failed, by_class, by_word, not failed and by_class <= CLASS_LIMIT and by_word <= WORD_LIMIT


def _judged(references: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            rows = zip(get["n_words"], get["n_repeat_words"], get["_lang"], map(np.array, get["_classes"]), map(np.array, get["_common"]))
            got = [_verdict(*row, references) for row in rows]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.bool_(), pa.float64(), pa.float64(), pa.bool_()))]
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("_lang", "_classes", "_common")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns],
                                             names=[*(batch.schema.names[i] for i in keep), "base_failed", "class_distance", "word_distance", "kept"])
    return run


def judge_quality(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id columns, the base measures, base_failed, both distances and kept.

    The texts are read for the common words of each language, and once more to be measured; the
    histograms are summed by language over all documents that pass the base rule, and the stored
    measures are then compared with the sums. A null or empty text has no words and fails.
    Documents without a language, or of one with fewer than MIN_DOCS documents, and those below the
    minimum lengths are judged by the base rule alone. Repeated rows are rows of their own; an empty
    table gives none.
    """
    thin, fields = _texts(docs, id_cols, text_col, lang_col)
    words = common_words(docs, text_col, lang_col)
    measured = stored(thin.mapInArrow(_measured(words), f"{fields}, {MEASURES}"), "quality-measures")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema.fields if f.name not in ("_lang", "_classes", "_common"))
    judged = measured.mapInArrow(_judged(references_of(measured, words)), f"{kept}, base_failed boolean, class_distance double, word_distance double, kept boolean")
    return judged.select(*renamed(id_cols), *judged.columns[len(id_cols):])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that ``judge_quality`` keeps, with all their columns. The texts are measured
    twice, which is cheaper than moving them to meet their verdicts."""
    thin, fields = _texts(docs, (), text_col, lang_col)
    words = common_words(docs, text_col, lang_col)
    references = references_of(thin.mapInArrow(_measured(words), f"{fields}, {MEASURES}"), words)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = (batch.column(batch.schema.get_field_index(c)) for c in (text_col, lang_col))
            keep = []
            for text, lang in zip(texts.cast(pa.binary()), langs):
                n, _, _, _, repeat, classes, common = measure(text.as_py() or b"", words.get(lang.as_py(), {}))
                keep.append(_verdict(n, repeat, lang.as_py(), classes, common, references)[3])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
