"""Toxicity, decontamination and the pipeline's stages against brute force over whole small tables."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, lines, pieces, toxicity

DIR = "/root/testdata/sf0.001"


def measured(text, weights, exceptions):
    """Every entry and exception sought by itself, at every place."""
    words = toxicity.fold(text or "")
    folded = f" {' '.join(words)} "

    def places(entry):
        at = folded.find(entry) if words else -1
        while at >= 0:
            yield at
            at = folded.find(entry, at + 1)

    found = {}
    for entry in sorted(weights, key=lambda e: (-weights[e], len(e))):
        for at in places(entry):
            found.setdefault(at, entry)
    held = [(at, at + len(x) + 2) for x in exceptions for at in places(f" {x} ")]
    left = {at: e for at, e in found.items() if not any(a <= at and at + len(e) <= b for a, b in held)}
    return sum(weights[e] for e in set(left.values())), sum(weights[e] for e in left.values()), len(left), len(words)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_toxicity_measures_as_a_naive_scan(docs):
    rng = random.Random(4)
    texts = [r.text for r in docs.collect()]
    vocabulary = sorted({w for t in texts for w in toxicity.fold(t or "")})
    entries = [e for w in rng.sample(vocabulary, 150) for e in (f" {w} ", f" {w[:3]}", f" {w[:5]}")]
    weights = {e: rng.choice([0.5, 1.0, 2.5, 4.0]) for e in entries}
    exceptions = [" ".join(rng.choice([t for t in texts if t]).split()[3:5]).lower() for _ in range(40)] + list(toxicity.EXCEPTIONS)
    lexicon = toxicity.Lexicon(weights, [x for x in exceptions if x == " ".join(toxicity.fold(x)) and f" {x} " not in weights], [-4.0, 1.0, 1.0, 0.0])
    # very long, tied and disguised texts too
    texts += [None, "", "Tr@sh c4n trash can. IDI0T idiot", " ".join(rng.choices(vocabulary, k=30_000)), "a" * 200_000]
    for t in texts:
        assert lexicon.measure(t) == pytest.approx(measured(t, weights, lexicon.exceptions))


def brute_findings(rows, items):
    """Every diagonal of every pair on which a mask's counting positions agree somewhere, compared word by word; the best
    stretch of a diagonal by trying all pairs of ends."""
    out = {}
    for doc_id, text in rows:
        words = decontaminate.words_of(text)
        where = collections.defaultdict(list)
        for i, w in enumerate(words):
            where[w].append(i)
        for item_id, item in items:
            if len(item) < decontaminate.LEAST_ITEM:
                continue
            same = collections.defaultdict(set)
            for j, w in enumerate(item):
                for i in where.get(w, ()):
                    same[i - j].add(j)
            masks = decontaminate.MASKS if len(item) >= decontaminate.SPAN else ("1" * len(item),)
            for diagonal, js in same.items():
                if not any(all(c == "0" or j + k in js for k, c in enumerate(m)) and 0 <= j + diagonal and j + diagonal + len(m) <= len(words) for m in masks for j in range(len(item) - len(m) + 1)):
                    continue
                lo, hi = max(0, -diagonal), min(len(item), len(words) - diagonal)
                best = None
                for a in range(lo, hi):
                    score = 0.0
                    for b in range(a, hi):
                        score += 1.0 if b in js else -decontaminate.MISS
                        if best is None or (score, -b, a) > best:
                            best = (score, -b, a)
                a, n = best[2], 1 - best[1] - best[2]
                equal = sum(j in js for j in range(a, a + n))
                if equal >= min(decontaminate.LEAST_EQUAL, len(item)) and equal >= decontaminate.LEAST_SHARE * n and (n >= decontaminate.LEAST_COVER * len(item) or n >= decontaminate.LEAST_WORDS):
                    one = (equal, -n, -(a + diagonal), len(item))
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), one), one)
    return {k: (-v[2], -v[1], v[0], v[3]) for k, v in out.items()}


def test_decontamination_against_every_diagonal(spark, docs):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(6)
    filler = [w for _, t in rows[:20] for w in (t or "").split()]
    for i in range(60):  # items with a share of their words replaced, twice in one text, at its ends, in a very long one
        item = [w.decode() if rng.random() > 0.04 * (i % 6) else "zz" for w in rng.choice(items)[1]]
        around = [rng.choices(filler, k=rng.choice([0, 5, 200])) for _ in range(3)]
        rows.append((1000 + i, " ".join([*around[0], *item, *around[1], *(item if i % 5 == 0 else []), *around[2]])))
    rows.append((2000, " ".join([*rng.choices(filler, k=40_000), *(w.decode() for w in items[3][1])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.findings(df, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()
    want = brute_findings(rows, items)
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_equal, r.item_words) for r in got} == want
    assert len(got) == len(want) and any(d >= 1000 for d, _ in want) and any(d < 1000 for d, _ in want)


def without_repeats(rows):
    seen, out = set(), {}
    for i, text in rows:
        every = (text or "").split("\n")
        at = [j for j, x in enumerate(every) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for a in range(len(at)):
            for n in range(1, lines.MIN_LINES + 1):
                part = tuple(every[j] for j in at[a : a + n])
                if len(part) == n and (n >= lines.MIN_LINES or sum(len(x.split()) for x in part) >= lines.MIN_WORDS):
                    if part in seen:
                        # blank lines between deleted ones go too
                        gone |= set(range(at[a], at[a + n - 1] + 1))
                    seen.add(part)
        if not at or not set(at) <= gone:
            out[i] = "\n".join(x for j, x in enumerate(every) if j not in gone)
    return out


def kept_of_each(rows, k=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return {i: t for i, t in rows if low[i] == i}


def test_stages_one_by_one(spark, docs):
    """Each stage on what the one before keeps: the same documents and texts as brute force, and the whole run's rows."""
    state = {r.doc_id: r.text for r in docs.collect()}
    columns, made = docs.columns, docs
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        rows = sorted(state.items())
        out = stage(spark, made, DIR)
        if name == "toxicity":
            state = {i: t for i, t in rows if lexicon.score(measured(t, lexicon.weights, lexicon.exceptions)) < corpus_pipeline.TOXIC}
        elif name == "line_dedup":
            state = without_repeats(rows)
        elif name == "minhash":
            state = kept_of_each(rows)
        elif name == "decontamination":
            bad = {d for d, _ in brute_findings(rows, items)}
            state = {i: t for i, t in rows if i not in bad}
        else:
            back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
            assert back == state and {r.doc_id: r.decoded_crc32 for r in out.collect()} == {i: zlib.crc32(t.encode()) for i, t in state.items()}
            break
        assert {r.doc_id: r.text for r in out.collect()} == state and out.columns == columns and len(state) <= len(rows), name
        made = spark.createDataFrame(out.collect(), docs.schema)
    assert {r.doc_id: r.decoded_crc32 for r in corpus_pipeline.run(spark, DIR).select("doc_id", F.col("decoded_crc32")).collect()} == {i: zlib.crc32(t.encode()) for i, t in state.items()}
