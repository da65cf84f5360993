"""Token alignment against offsets counted by hand, with byte tables from another file."""

import base64
import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jetforge.llm import alignment

FOLDER = alignment.FOLDER


@pytest.fixture(scope="module")
def encoders():
    first = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        a = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    return first, second, a, b


def by_hand(encoders, texts):
    first, second, bytes_a, bytes_b = encoders
    docs, held = [], Counter()
    for text in texts:
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        spans = [[bytes_a[i] for i in a], [bytes_b(i) for i in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spans):
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spans]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links = defaultdict(lambda: ([], [])), []
        for side, (ids, stops) in enumerate(zip((a, b), ends)):
            for i, stop in zip(ids, stops):
                groups[cuts[bisect_left(cuts, stop)]][side].append(i)
        for i, x in zip(a, ends[0]):
            links += [(i, b[k]) for k in (bisect_left(ends[1], x),) if ends[1][k] == x]
        held.update(links)
        listed = ";".join(",".join(map(str, groups[c][0])) + "|" + ",".join(map(str, groups[c][1])) for c in cuts)
        docs.append((len(a), len(b), len(cuts), links, hashlib.sha256(listed.encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in held.items():
        most[b] = max(most[b], n)
    out = []
    for d in docs:
        out.append((0, 0, 0, 0, 0, 0, "") if d is None else
                   (d[0], d[1], d[2], len(d[3]), sum(held[x] == most[x[1]] for x in d[3]), sum(held[x] for x in d[3]), d[4]))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  two  spaces ", "<|endoftext|> <s> </s>", "block ▁ mark", "日本語のテキスト", "naïve café 🙂🙂 x", "tabs\tand\r\nlines\n\n", "\x00 zero", "a" * 5000, "it's we're o'k"]


@pytest.mark.parametrize("size", [1 << 16, 40])
def test_alignment(spark, encoders, sf, size):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += [texts[20], " ".join(random.Random(1).choices("one two three four's 56 naïve".split(), k=4000))]
    docs = spark.createDataFrame([(i if i else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, code string, times int")
    got = alignment.align(docs, chunk_chars=size).collect()
    assert {(r.doc_id or 0): tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(by_hand(encoders, texts)))


def test_frequent_pairs_without_broadcast(spark, encoders, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(alignment.align(docs, max_pairs=0)) == rows(alignment.align(docs))


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema)).count() == 0
    got = alignment.align(spark.createDataFrame([(1, "same words"), (1, "same words"), (None, None)], schema)).collect()
    assert [(r.n_a, r.n_links, r.count_sum) for r in got if r.doc_id] == [(2, 2, 4)] * 2 and got[0].asDict().keys() == {"doc_id", *COLUMNS}


def random_stream(rng, n):
    """Tokens of two streams over n bytes, with end offsets."""
    out = []
    for _ in range(2):
        ends = sorted(rng.sample(range(1, n), rng.randint(0, min(n - 1, 12)))) + [n]
        out.append(([rng.randint(0, 9) for _ in ends], ends))
    return out


def test_fragments_are_a_monoid_over_any_byte_ranges():
    """Cut anywhere, also inside tokens, and composed in any grouping: the same whole."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(2, 40)
        (a, ea), (b, eb) = random_stream(rng, n)
        whole = alignment.between(*map(np.array, (a, b, ea, eb)))
        marks = [0, *sorted(rng.sample(range(1, n), rng.randint(0, min(n - 1, 6)))), n]
        parts = []
        for lo, hi in zip(marks, marks[1:]):
            pick = lambda ids, ends: ([i for i, e in zip(ids, ends) if lo < e <= hi], [e for e in ends if lo < e <= hi])
            (pa, pea), (pb, peb) = pick(a, ea), pick(b, eb)
            parts.append(alignment.between(*(np.array(v, np.int64) for v in (pa, pb, pea, peb))))
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert ";".join(parts[0].groups()) == ";".join(whole.groups()) and parts[0].links.tolist() == whole.links.tolist()
        assert (parts[0].n_a, parts[0].n_b) == (len(a), len(b)) and [list(x) for x in parts[0].suffix] == [[], []]


def test_chunks_encode_as_the_whole(encoders):
    tokenizers = alignment.load(FOLDER)
    assert tokenizers.cuttable
    text = "The quick  brown fox's 12 jumps, over naïve\n lazy_dogs and so on again and again. " * 30
    whole = next(tokenizers.encode([text]))
    parts = list(tokenizers.encode(alignment.chunks(text, True, 50)))
    assert len(parts) > 20 and [np.concatenate([p[k] for p in parts]).tolist() for k in (0, 1)] == [w.tolist() for w in whole]
    assert alignment.chunks("x" * 1000, True, 50) == ["x" * 1000]


def test_long_word_is_not_quadratic():
    tokenizers = alignment.load(FOLDER)
    (a, b), = tokenizers.encode(["a" * 500_000])
    assert alignment.fragment(tokenizers, "a" * 500_000, a, b).right


def test_byte_level_ids_are_those_of_the_file(encoders):
    """Every character of the first plane, alone, between letters and spaces, and repeated."""
    first, tokenizers = encoders[0], alignment.load(FOLDER)
    for start in range(0, 0x10000, 256):
        chars = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b {c} {c}{c} x{c}1 \n{c} {c}'s" for c in chars]
        assert [e.ids for e in first.encode_batch(texts, add_special_tokens=False)] == [tokenizers.first.encode_ordinary(t) for t in texts]

