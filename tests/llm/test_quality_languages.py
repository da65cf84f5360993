"""Quality references counted from the corpus: more languages, and both distances by hand."""

import math
import random
from collections import Counter

import pytest

from jetforge.llm import quality

WORDS = {"ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у который то за свой".split(),
         "it": "di e il la che in a per un è del non le si una i da con come sono al più ma della".split(),
         "xx": "ka lo mi nu pe".split()}


def made_up(lang, n, seed, words=300):
    rng = random.Random(seed)
    rare = ["".join(rng.choices("абвгдежзиклмнопрст" if lang == "ru" else "abcdefghilmnopqrstuvz", k=rng.randint(4, 9))) for _ in range(2000)]
    common = WORDS[lang]
    out = []
    for _ in range(n):
        picked = [rng.choices(common, [1 / (i + 2) for i in range(len(common))])[0] if rng.random() < 0.4 else rng.choice(rare) for _ in range(words)]
        out.append(" ".join(w.capitalize() + "." if i % 12 == 0 else w for i, w in enumerate(picked)))
    return out


@pytest.fixture(scope="module")
def rows():
    docs = [(lang, t) for k, lang in enumerate(("ru", "it")) for t in made_up(lang, 80, k)]
    docs += [("xx", t) for t in made_up("xx", 3, 9)] + [(None, t) for t in made_up("it", 3, 8)]
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choices("QZX0123456789%&#", k=6)) for _ in range(200)) for _ in range(6)]
    docs += [("ru", t) for t in junk[:3]] + [("it", t) for t in junk[3:]]
    return [(i, lang, t) for i, (lang, t) in enumerate(docs)] + [(900, "ru", None), (901, "it", ""), (902, "it", "short text")]


def test_further_languages(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, _common string")
    got = {r.doc_id: r for r in quality.judge_quality(frame).collect()}
    kept = {i for i, r in got.items() if r.kept}
    assert {i for i, lang, _ in rows[:166]} <= kept  # all clean ones, also of a rare language and of none
    assert not kept & set(range(166, 172)) and not kept & {900, 901, 902}
    assert {r.doc_id for r in quality.keep_good(frame).collect()} == kept


def by_hand(rows):
    """class_distance and word_distance of each document."""
    plain = lambda w: "".join(c.lower() if c.isascii() else c for c in w).strip(quality._EDGES.decode())
    words = {i: (t or "").split() for i, _, t in rows}
    counts, n_docs = {}, Counter()
    for i, lang, _ in rows:
        if lang is not None and len(words[i]) >= quality.MIN_WORDS:
            counts.setdefault(lang, Counter()).update(plain(w) for w in words[i])
            n_docs[lang] += 1
    top = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode())) if w][:quality.COMMON] for k, c in counts.items() if n_docs[k] >= quality.MIN_DOCS}

    def histograms(lang, text, found):
        classes = [0] * 7
        for c in text or "":
            k = (6 if ord(c) > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:?'\"()-" else 5)
            classes[k] += 1
        common = Counter(plain(w) for w in found)
        own = [common[w] for w in top[lang]]
        return classes, [*own, len(found) - sum(own)]

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        return math.sqrt(max((part(p, q) + part(q, p)) / 2, 0))

    chance = lambda n, bins: math.sqrt((bins - 1) / (8 * math.log(2) * n))
    own = {i: histograms(lang, t, words[i]) for i, lang, t in rows if lang in top}
    failed = lambda i: len(words[i]) < 20
    sums = {k: [[sum(own[i][h][b] for i, lang, _ in rows if lang == k and not failed(i)) for b in range(n)] for h, n in ((0, 7), (1, len(top[k]) + 1))] for k in top}
    out = {}
    for i, lang, t in rows:
        if lang not in top:
            out[i] = (0.0, 0.0)
            continue
        (classes, common), (c_ref, w_ref) = own[i], sums[lang]
        by_class = distance(classes, c_ref) - chance(sum(classes), 7) if sum(classes) >= quality.CLASS_CHARS else 0.0
        by_word = distance(common, w_ref) - chance(len(words[i]), len(common)) if len(words[i]) >= quality.WORD_WORDS else 0.0
        out[i] = (max(by_class, 0.0), max(by_word, 0.0))
    return out


def test_distances_and_verdict_by_hand(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = by_hand(rows)
    for r in quality.judge_quality(frame).collect():
        assert (r.class_distance, r.word_distance) == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.kept == (not r.base_failed and r.class_distance <= quality.CLASS_LIMIT and r.word_distance <= quality.WORD_LIMIT)


def test_bounded_counters_lose_no_frequent_word():
    rng = random.Random(1)
    words = Counter({f"rare{i}": rng.randint(1, 5) for i in range(50_000)}) + Counter({f"often{i}": 3000 + i for i in range(30)})
    kept = quality._reduced(words)
    assert len(kept) <= quality.SUMMARY and all(0 <= words[f"often{i}"] - kept[f"often{i}"] <= 5 for i in range(30))
