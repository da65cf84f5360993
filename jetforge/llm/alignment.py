"""Alignment of two tokenizers over byte offsets, as a monoid of fragments.

Both token streams of a text cover the same bytes. Where a token of each ends at one offset the
text is cut into groups. A stretch of text is a fragment: an open prefix (up to its first cut), the
closed groups between its cuts, and an open suffix (behind its last one). Fragments that follow one
another compose, in any grouping, so that a very long text is encoded in byte-range chunks by many
tasks and put together by a tree of small groups. Chunks are cut at a single space between two
other characters, over which neither vocabulary joins anything.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import attach
from .common import ids_of, quoted, renamed, stored

FOLDER = "/opt/tokenizers"  # on every executor; a parameter
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_CHARS = 1 << 16  # a longer text is cut into chunks of about so many characters
FAN = 8  # fragments composed at a time
TASK_CHARS = 1 << 22  # characters of long texts that a task encodes, about
BATCH_CHARS = 1 << 19  # characters handed to a tokenizer at once, about
MAX_PAIRS = 1 << 20  # rows of the pair table (24 bytes each) that are broadcast at most

_CUT = re.compile(r" (?<=[^\s\u180e] )(?=[^\s\u180e])")
_CROSSES = re.compile(r"\S ")
# Fixed value: how byte-level vocabularies of this kind split a text before they join bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 stands for
    itself, the others follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokens:
    """Bytes of each id, and how many."""
    data: list[bytes]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sizes = np.array([len(d) for d in self.data], np.int64)


def _byte_level(path: str):
    """Encoder and token bytes of a byte-level vocabulary file. Its merges must be in the order of
    the ids they give: then joining the pair of least id is joining by the first merge."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if split["type"] != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError("not a byte-level vocabulary that splits texts by its pattern")
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:])):
        raise ValueError("the merges are not in the order of their ids")
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in entry): i for entry, i in vocab.items() if entry not in special}
    data = [b""] * (1 + max(ranks.values()))
    for d, i in ranks.items():
        data[i] = d
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), data


class Tokenizers:
    """Both tokenizers and the bytes of their ids. ``cuttable``: no piece holds a space behind
    another character, so that nothing is joined over a cut (the byte-level split starts anew there)."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.first, a = _byte_level(byte_level)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        b, plain = [], []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            if self.second.is_byte(i):
                b.append(bytes([int(piece[3:5], 16)]))
            else:
                plain.append(piece.replace("▁", " "))
                b.append(plain[-1].encode())
        self.a, self.b = Tokens(a), Tokens(b)
        self.cuttable = not any(_CROSSES.search(t) for t in plain)

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the space and the text, and of the text, for each; some texts at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < BATCH_CHARS:
                size += len(texts[end])
                end += 1
            for text, b in zip(texts[at:end], self.second.encode(list(texts[at:end]), num_threads=1)):
                yield self.first.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), np.array(b, np.int64)
            at = end


@cache
def load(folder: str, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Tokenizers:
    return Tokenizers(os.path.join(folder, byte_level), os.path.join(folder, pieces))


@dataclass
class Fragment:
    """Tokens that end in a stretch of bytes. Without a cut all of them are the prefix. ``links``
    are the pairs that end together, as a * 2^32 + b; ``right``: both streams gave the bytes."""
    cut: bool = False
    prefix: tuple[list[int], list[int]] = ((), ())
    closed: list[str] = field(default_factory=list)
    suffix: tuple[list[int], list[int]] = ((), ())
    n_a: int = 0
    n_b: int = 0
    n_closed: int = 0
    links: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    right: bool = True

    def __add__(self, other: Fragment) -> Fragment:
        both = lambda x, y: (list(x[0]) + list(y[0]), list(x[1]) + list(y[1]))
        sums = dict(n_a=self.n_a + other.n_a, n_b=self.n_b + other.n_b, links=np.concatenate([self.links, other.links]), right=self.right and other.right)
        if not other.cut:
            open_end = {"suffix": both(self.suffix, other.prefix), "prefix": self.prefix} if self.cut else {"prefix": both(self.prefix, other.prefix)}
            return Fragment(cut=self.cut, closed=self.closed, n_closed=self.n_closed, **open_end, **sums)
        if not self.cut:
            return Fragment(cut=True, prefix=both(self.prefix, other.prefix), closed=other.closed, n_closed=other.n_closed, suffix=other.suffix, **sums)
        joint = group(*both(self.suffix, other.prefix))
        return Fragment(cut=True, prefix=self.prefix, closed=[*self.closed, joint, *other.closed], n_closed=self.n_closed + 1 + other.n_closed, suffix=other.suffix, **sums)

    def groups(self) -> list[str]:
        """Of a whole text: prefix and closed groups. Its last offset is a cut."""
        return [group(*self.prefix), *self.closed] if self.cut else []


def group(a: Sequence[int], b: Sequence[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


@cache
def _decimals(bits: int) -> list[str]:
    """Each id below 2^bits as text, followed by a comma, a bar or a semicolon."""
    return [f"{i}{mark}" for i in range(1 << bits) for mark in ",|;"]


def between(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """Fragment of tokens with their end offsets, both rising."""
    at = np.searchsorted(ends_b, ends_a)
    hit = np.flatnonzero(at < len(ends_b))
    hit = hit[ends_b[at[hit]] == ends_a[hit]]
    if not len(hit):
        return Fragment(prefix=(a.tolist(), b.tolist()), n_a=len(a), n_b=len(b))
    stop_a, stop_b = hit + 1, at[hit] + 1
    (i, p), (j, q) = stop_a[[0, -1]].tolist(), stop_b[[0, -1]].tolist()
    # The tokens between the first cut and the last, group by group, those of a before those of b.
    n_a, n_b = np.diff(stop_a), np.diff(stop_b)
    text = np.empty(p - i + q - j, np.int64)
    text[np.arange(p - i) + np.repeat(stop_b[:-1] - j, n_a)] = 3 * a[i:p]
    text[np.arange(q - j) + np.repeat(stop_a[1:] - i, n_b)] = 3 * b[j:q]
    text[(stop_a[1:] - i) + (stop_b[:-1] - j) - 1] += 1
    text[(stop_a[1:] - i) + (stop_b[1:] - j) - 1] += 2
    marked = _decimals(int(max(a.max(), b.max())).bit_length())
    closed = "".join([marked[k] for k in text.tolist()])[:-1]
    links = (a[hit] << 32) | b[at[hit]]
    return Fragment(True, (a[:i].tolist(), b[:j].tolist()), [closed] if closed else [], (a[p:].tolist(), b[q:].tolist()), len(a), len(b), len(hit) - 1, links)


def fragment(tokenizers: Tokenizers, body: str, a: np.ndarray, b: np.ndarray) -> Fragment:
    """Of the tokens of a space and ``body``."""
    whole = (" " + body).encode()
    first, second = tokenizers.a, tokenizers.b
    if b"".join([first.data[i] for i in a.tolist()]) != whole or b"".join([second.data[i] for i in b.tolist()]) != whole:
        return Fragment(right=False)
    return between(a, b, np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b]))


def chunks(text: str, cuttable: bool = True, size: int = CHUNK_CHARS) -> list[str]:
    """A text in parts of about ``size`` characters, cut at a single space between two other
    characters, which goes: each part is encoded as a text of its own, behind a space. What holds
    no such place stays whole."""
    out, start = [], 0
    while cuttable and len(text) - start > size and (m := _CUT.search(text, start + size)):
        out.append(text[start:m.start()])
        start = m.end()
    return [*out, text[start:]]


_RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"
_FRAGMENT = "cut boolean, prefix_a array<int>, prefix_b array<int>, closed string, suffix_a array<int>, suffix_b array<int>, n_a long, n_b long, n_closed long, links array<long>, right boolean"


def _result(whole: Fragment) -> tuple:
    if not whole.right or not whole.cut:
        return 0, 0, 0, 0, "", [], []
    codes, times = np.unique(whole.links, return_counts=True)
    digest = hashlib.sha256(";".join(whole.groups()).encode()).hexdigest()
    return whole.n_a, whole.n_b, whole.n_closed + 1, len(whole.links), digest, codes, times


def _result_columns(rows: list[tuple]) -> list[pa.Array]:
    types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _put_together(tokenizers: Tokenizers, texts: Sequence[str]) -> Iterator[Fragment]:
    for text, (a, b) in zip(texts, tokenizers.encode(texts)):
        yield fragment(tokenizers, text, a, b)


def _encoded(folder: str, size: int):
    """Task side: the result of every text of one chunk; the chunks of longer ones as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = load(folder)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "chunk", "body", *_names(_RESULT)]
            parts = {i: c for i, t in enumerate(texts) if len(t) > size and len(c := chunks(t, tokenizers.cuttable, size)) > 1}
            short = [i for i in range(len(texts)) if i not in parts]
            found = _put_together(tokenizers, [texts[i] for i in short if texts[i]])
            rows = [_result(next(found) if texts[i] else Fragment()) for i in short]
            take = batch.take(pa.array(short, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*take.columns[:-1], pa.array([0] * len(short), pa.int32()), pa.nulls(len(short), pa.string()), *_result_columns(rows)], names=names)
            for i, bodies in parts.items():
                for k, body in enumerate(bodies):
                    row = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays(
                        [*row.columns[:-1], pa.array([k], pa.int32()), pa.array([body]), *_result_columns([(None,) * 7])], names=names)
    return run


def _fragments(folder: str):
    """Task side: chunks (``_row``, chunk, body) as fragments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = load(folder)
        for batch in batches:
            found = list(_put_together(tokenizers, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"_row": batch.column(0).to_pandas(), "chunk": batch.column(1).to_pandas()} | _written(found)),
                                             schema=_arrow_schema(batch.schema), preserve_index=False)
    return run


def _arrow_schema(given: pa.Schema) -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([given.field(0), given.field(1), *[pa.field(p.split()[0], kinds[p.split()[1]]) for p in _FRAGMENT.split(", ")]])


def _written(found: list[Fragment]) -> dict[str, list]:
    return {"cut": [f.cut for f in found], "prefix_a": [list(f.prefix[0]) for f in found], "prefix_b": [list(f.prefix[1]) for f in found],
            "closed": [";".join(f.closed) for f in found], "suffix_a": [list(f.suffix[0]) for f in found], "suffix_b": [list(f.suffix[1]) for f in found],
            "n_a": [f.n_a for f in found], "n_b": [f.n_b for f in found], "n_closed": [f.n_closed for f in found],
            "links": [f.links for f in found], "right": [f.right for f in found]}


def _read(row) -> Fragment:
    return Fragment(bool(row.cut), (list(row.prefix_a), list(row.prefix_b)), [row.closed] if row.n_closed else [], (list(row.suffix_a), list(row.suffix_b)),
                    int(row.n_a), int(row.n_b), int(row.n_closed), np.asarray(row.links, np.int64), bool(row.right))


def _composed(pdf: pd.DataFrame) -> Fragment:
    parts = [_read(r) for r in pdf.sort_values("chunk").itertuples()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return whole


def _compose_step(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"_row": pdf["_row"].iloc[:1].to_numpy(), "chunk": [int(pdf["chunk"].min()) // FAN]} | _written([_composed(pdf)]))


def _compose_end(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(pdf["_row"].iloc[0], *_result(_composed(pdf)))], columns=["_row", *_names(_RESULT)])


def _long_texts(parts: DataFrame, n_chunks: int, n_chars: int, folder: str) -> DataFrame:
    """Results of the texts in chunks: each chunk encoded where it lands, then FAN fragments at a
    time composed until a text is one."""
    spread = parts.repartition(max(1, -(-n_chars // TASK_CHARS)), "_row", "chunk")
    found = spread.mapInArrow(_fragments(folder), f"_row long, chunk int, {_FRAGMENT}")
    while n_chunks > FAN:
        found = found.groupBy("_row", F.floor(F.col("chunk") / FAN)).applyInPandas(_compose_step, f"_row long, chunk int, {_FRAGMENT}")
        n_chunks = -(-n_chunks // FAN)
    return found.groupBy("_row").applyInPandas(_compose_end, f"_row long, {_RESULT}")


def aligned(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", folder: str = FOLDER, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Private ids, ``_row`` and the results of every document, written once: counts, digest, and
    its linked pairs as ``codes`` (a * 2^32 + b) with how often (``times``)."""
    thin = docs.select(*ids_of(docs, id_cols), F.monotonically_increasing_id().alias("_row"), quoted(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema.fields[:-1])
    # Written at once: from here on a row's number stays with it.
    rows = stored(thin.mapInArrow(_encoded(folder, chunk_chars), f"{fields}, chunk int, body string, {_RESULT}"), "encoded")
    short = rows.where(F.col("body").isNull()).drop("chunk", "body")
    parts = rows.where(F.col("body").isNotNull())
    size = parts.agg(F.max("chunk").alias("last"), F.sum(F.char_length("body")).alias("chars")).first()
    if size["last"] is None:
        return short
    long_rows = stored(_long_texts(parts.select("_row", "chunk", "body"), size["last"] + 1, size["chars"], folder), "composed")
    ids = parts.where("chunk = 0").select(*[c for c in short.columns if c.startswith("_id")], "_row")
    return short.unionByName(ids.join(long_rows, "_row"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """Of every linked pair of ids: code, ``held`` (links of the corpus that hold it) and ``best``
    (whether no pair of its second id is held more often). A second id has at most as many pairs
    as the first vocabulary has entries."""
    pairs = rows.select(F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("held"))
    second = Window.partitionBy(F.col("code").bitwiseAND(F.lit(2**32 - 1)))
    return pairs.withColumn("best", F.col("held") == F.max("held").over(second))


def align(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", folder: str = FOLDER, chunk_chars: int = CHUNK_CHARS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row per document: id columns, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256.

    A is the byte-level vocabulary over a space and the text, B the piece vocabulary over the text
    (it adds the space); special tokens are plain text. Offsets where a token of each ends cut the
    streams into groups; the two tokens that end there are linked. ``count_sum`` adds up, over the
    links, how many links of the corpus hold the same two ids; ``n_best`` counts the links whose
    number is the highest of their B id.

    Null and empty texts, and texts whose tokens of A or B do not give back the space and the text,
    have no tokens: zeros and an empty groups_sha256. Texts over ``chunk_chars`` characters are
    encoded in chunks by many tasks; one without a place to cut stays whole. Repeated rows are rows
    of their own; null ids stay; an empty table gives none. Other columns are ignored. ``folder``
    holds the vocabularies on every executor.
    """
    rows = aligned(docs, id_cols, text_col, folder, chunk_chars)
    pairs = stored(pair_counts(rows), "pair-counts")
    each = rows.select("*", F.explode_outer(F.arrays_zip("codes", "times")).alias("p")).drop("codes", "times")
    # Documents without links get codes of their own, which no pair has, so that they do not share a key.
    each = each.select("*", F.coalesce(F.col("p.codes"), -1 - F.col("_row")).alias("code"), F.col("p.times").alias("times")).drop("p")
    if pairs.count() <= max_pairs:
        met = each.join(F.broadcast(pairs), "code", "left")
    else:  # pairs that stand in very many documents meet their rows where they lie
        met = attach(each, pairs, ["code"])
    ids = [c for c in rows.columns if c.startswith("_id")]
    kept = [*ids, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in kept],
                                  F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"),
                                  F.coalesce(F.sum(F.col("times") * F.col("held")), F.lit(0)).alias("count_sum"))
    return out.select(*renamed(id_cols), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
