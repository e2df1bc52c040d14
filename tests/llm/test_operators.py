"""Small tables with nulls, empty texts, repeated rows, clashing columns, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontaminate, licenses, lines, media, neardup, passages, pieces, registry, shards, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, kept boolean, n_lines long"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    rows = [(i, "\n".join([base[i % 6][:150], base[i % 6][150:260], base[i % 6][260:], f"own {i} {rng.random()}"])) for i in range(30)]
    rows += [(30, None), (31, ""), (32, " \n\t\n"), (None, base[0]), (None, None), (33, base[1]), (33, base[1]), (34, "one"), (35, "x " * 3000)]
    return spark.createDataFrame([(i, t, None, "s" if i is None or i % 2 else None, 1, 7, True, 3) for i, t in rows], SCHEMA)


def empty(odd):
    return odd.limit(0)


def brute_classes(rows, k):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                s, t = sets[a], sets[b]
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and low[b] > low[a]:
                    low[b], changed = low[a], True
    return {i: (len(sets[i]), low[i]) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_neardup(spark, odd, k):
    want = brute_classes([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], k)
    got = neardup.classes(odd, k).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    stay = neardup.keep_one(odd, k)
    assert stay.columns == odd.columns and stay.count() == sum(i == c for i, (_, c) in want.items()) + 2
    assert neardup.classes(empty(odd), k).count() == 0


def test_block_step_finds_links_between_others(spark):
    """Texts whose link isn't with their bucket's least doc_id."""
    a = [f"w{i}" for i in range(100)]
    edit = lambda w, where: [f"z{i}" if i in where else x for i, x in enumerate(w)]
    rows = [(0, a), (1, edit(a, range(0, 14))), (2, edit(a, range(0, 16))), (3, edit(a, range(80, 94))), (4, edit(a, range(78, 94)))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    want = brute_classes([(i, " ".join(w)) for i, w in rows], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(df, 2).collect()} == want


def test_lines(spark, odd):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    got = lines.op1_line_dedup(spark, DIR).toPandas().sort_values("doc_id")
    want = con.execute(lines.SQL).df().sort_values("doc_id")[list(got.columns)]
    assert got.values.tolist() == want.values.tolist()
    out = lines.drop_repeated_lines(odd)
    assert out.columns == odd.columns and lines.dedup_lines(empty(odd)).count() == 0
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0].count("\n") == 3 and texts[6].startswith("own 6") and texts[30] is None and texts[32] == " \n\t\n"
    assert {r.n_lines for r in lines.dedup_lines(odd).collect()} == {3} and "n_lines_" in lines.dedup_lines(odd).columns


def test_lines_against_brute_force(spark):
    """Random sequences of few lines, long copies, a line of many words: the lines that go, and that each run stands whole
    in its first copy."""
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(6)] + [" ".join(f"{c}{i}" for i in range(lines.MIN_WORDS - 2)) for c in "ab"]
    docs = [[rng.choice(pool) for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    docs += [docs[3] * 3, docs[4][2:] + docs[5], [f"u{i}" for i in range(200)], ["x", *(f"u{i}" for i in range(200)), "y"], [" ".join(["long"] * 50)], ["a", " ".join(["long"] * 50)]]
    df = spark.createDataFrame(list(enumerate("\n".join(d) for d in docs)), "doc_id long, text string")
    seen, want = set(), {}
    for i, d in enumerate(docs):
        gone = set()
        for a in range(len(d)):
            for n in range(1, lines.MIN_LINES + 1):
                part = tuple(d[a : a + n])
                if len(part) == n and (n >= lines.MIN_LINES or len(" ".join(part).split()) >= lines.MIN_WORDS):
                    gone |= set(range(a, a + n)) if part in seen else set()
                    seen.add(part)
        want[i] = (len(gone), "\n".join(x for j, x in enumerate(d) if j not in gone))
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert {i: (r.n_deleted, r.text) for i, r in got.items()} == want
    assert (got[28].n_runs, got[28].longest_run) == (1, 200) and got[30].n_deleted == 1
    # lengths by comparing every suffix with every earlier one; a run is a span that no span from a lesser place holds
    runs, suffixes = set(), [(i, a) for i in range(len(docs)) for a in range(len(docs[i]))]
    for i, d in enumerate(docs):
        stop = -1
        for a in range(len(d)):
            n, least = 0, None
            for j, b in suffixes:
                if (j, b) >= (i, a):
                    break
                e = docs[j]
                k = 0
                while a + k < len(d) and b + k < len(e) and d[a + k] == e[b + k]:
                    k += 1
                n, least = (k, (j, b)) if k > n else (n, least)
            if n and (n >= lines.MIN_LINES or len(" ".join(d[a : a + n]).split()) >= lines.MIN_WORDS) and a + n > stop:
                runs.add((i, a, n, a + n - 1, *least, a + n - max(a, stop)))
                stop = a + n
    got = lines.later_runs(df.withColumns({"d": F.col("doc_id"), "t": F.xxhash64("text")})).collect()
    assert {(r.d, r.place, r.n, r.last, r.first.d, r.first.place, r.fresh) for r in got} == runs and len(got) == len(runs)


def test_shards(spark, odd):
    got = shards.interleave(odd, 4).toPandas()
    assert len(got) == odd.count()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert shards.interleave(empty(odd)).count() == 0
    texts = dict(duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall())
    assert all(zlib.crc32((texts[r.doc_id] or "").encode()) == r.text_crc32 for r in shards.op2_sharding(spark, DIR).collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DIR), con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_toxicity(spark, odd):
    got = toxicity.op3_toxicity(spark, DIR).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " trash ": 4.0}, list(toxicity.EXCEPTIONS), [-4.0, 1.0, 1.0, 0.0])
    assert lexicon.measure("You 1di0t, іdiot!")[2] == 2
    assert lexicon.measure("the trash can and trash")[2] == 1
    assert toxicity.score(odd, lexicon).count() == odd.count() and toxicity.score(empty(odd), lexicon).count() == 0
    none = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.drop_toxic(odd, none, 0.5).count() == odd.count()


def test_toxicity_learns_from_documents_that_share_a_word(spark):
    rows = [(i, f"aaa {'zorgle' if i % 2 else 'lamp'} " + " ".join(f"bbb{i}x{j}" for j in range(3)), i % 2) for i in range(80)]
    common = min((f"c{i}" for i in range(20_000)), key=lambda w: toxicity.xxhash.xxh64_intdigest(w))
    docs = spark.createDataFrame([(i, f"{common} {t}") for i, t, _ in rows] + [(100 + i, f"{common.upper()}, unusual!") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(100 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    weights = toxicity.learn(docs, labels).weights
    assert " zorgle " in weights and " unusual " not in weights and f" {common} " not in weights


def test_shards_over_many_spans(spark, monkeypatch):
    """Buckets of few rows and spans of few buckets change no shard and no slot."""
    want = {tuple(r) for r in shards.op2_sharding(spark, DIR).collect()}
    monkeypatch.setattr(shards, "BUCKET_ROWS", 3)
    monkeypatch.setattr(shards, "SPAN", 4)
    assert {tuple(r) for r in shards.op2_sharding(spark, DIR).collect()} == want


def test_licenses(spark, odd):
    texts = ["Use the MIT-License or MIT license; GNU General Public License, version 3", "mit license", "Licensed under the Apache License, Version 2.0.", "Кmit license Kapache license", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (3, 2, 8, "gpl,mit")
    assert (got[1].n_base, got[1].first_word) == (0, None) and got[1].n_words == 1
    assert got[2].labels == "apache,apache-2.0" and [m.label for m in got[2].found] == ["apache-2.0"]
    assert got[3].n_base == 0 and got[4].n_words == 0 and got[4].score == 0
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty(odd)).count() == 0


def test_licenses_without_the_word_licence(spark):
    want = {"Apache-2.0": "apache-2.0", "MPL 2.0": "mpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.1": "lgpl-2.1", "EPL-2.0": "epl-2.0", "BSD-3-Clause": "bsd-3-clause", "0BSD": "0bsd", "CC BY-SA 4.0": "cc-by-sa-4.0",
            "published by the Free Software\nFoundation": "gpl", "All rights\nreserved": "proprietary", "public-domain": "public-domain", "nothing here": ""}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()] == list(want.values())


def test_pieces(spark, odd):
    import sentencepiece

    library, plain, varied = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Pieces.load(dropout=0.0), pieces.Pieces.load(dropout=0.3)
    for text in ["Hello  world\n\tx", " lead", "é日本\U0001f600", "a" * 200, "", "x\0y"]:
        assert plain.encode(text, 1) == library.encode(text)
        assert varied.decode(varied.encode(text, 1)) == text or text == ""
    assert varied.decode(varied.encode("a▁b", 1)) == "a▁b"
    assert pieces.encode(odd).count() == odd.count() and pieces.encode(empty(odd)).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(odd.filter("doc_id is not null"))).collect()} == {d: t for d, t in texts.items() if d is not None}


def test_pieces_many_at_once_equal_one_by_one():
    import numpy as np

    rng = random.Random(1)
    letters = "etaoinshrdlucmfwypvbgkqjxz" * 3 + "ABC 019._-éüßñ日本语"
    chunks = ["".join(rng.choices(letters, k=rng.choice([1, 2, 4, 6, 8, 12, 38, 39, 40, 41, 42, 90]))) for _ in range(6000)]
    text = duckdb.sql(f"select string_agg(text, ' ') from (select text from '{DIR}/documents.parquet' order by doc_id limit 60)").fetchall()[0][0]
    chunks += pieces.Pieces.load().chunks(text)[:6000]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        p = pieces.Pieces.load(dropout=dropout)
        keys = pieces.chunk_keys(3, np.arange(len(chunks), dtype=np.uint64), np.arange(len(chunks)))
        assert p.segment_many(chunks, keys) == [p.segment(c, int(k)) for c, k in zip(chunks, keys, strict=True)]


def test_pieces_trees_equal_one_by_one(monkeypatch):
    import numpy as np

    monkeypatch.setattr(pieces, "NODES", 9000)
    rows = duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet' where text is not null order by doc_id limit 80").fetchall()
    p = pieces.Pieces.load(dropout=0.1)
    varied = collections.defaultdict(set)
    for lo in range(0, len(rows), 16):
        part = rows[lo : lo + 16]
        for (d, text), got in zip(part, p.encode_many([t for _, t in part], [d for d, _ in part]), strict=True):
            mine = p.chunks(" " + text)
            keys = pieces.chunk_keys(p.seed, np.full(len(mine), d, np.uint64), np.arange(len(mine)))
            want = [p.segment(c, int(k)) for c, k in zip(mine, keys, strict=True)]
            assert got.tolist() == [i for x in want for i in x] and p.decode(got.tolist()) == text
            for c, x in zip(mine, want, strict=True):
                varied[c].add(tuple(x))
    assert max(map(len, varied.values())) > 8


def test_decontamination(spark, odd):
    rng = random.Random(2)
    item = [f"b{rng.randrange(500)}" for _ in range(30)]
    changed = [f"c{i}" if i % 6 == 5 else w for i, w in enumerate(item)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "only five short words here")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "x y z " + " ".join(item)), (1, " ".join(changed) + " tail"), (2, " ".join(item[:6])), (3, None), (None, " ".join(item)), (4, "so Only five, short words here!")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.findings(docs, items).collect()}
    assert set(got) == {(0, 1), (1, 1), (None, 1), (4, 3)}
    assert (got[0, 1].first_word, got[0, 1].n_words, got[0, 1].n_equal) == (3, 30, 30) and got[1, 1].n_equal == 25
    more = docs.unionByName(spark.createDataFrame([(None, "a clean text of a few words"), (0, "another clean text of a few words")], "doc_id long, text string")).withColumns({"_bad": F.lit(1), "h": F.lit(2), "item_id": F.lit(3)})
    left = decontaminate.drop_contaminated(more, items)
    assert left.columns == more.columns and sorted((r.doc_id or -1, (r.text or "")[:7]) for r in left.collect()) == sorted([(2, " ".join(item)[:7]), (3, ""), (-1, "a clean"), (-1, "another")])
    assert decontaminate.findings(empty(odd), items).count() == 0 and decontaminate.findings(odd, items.limit(0)).count() == 0


def test_recall_of_items_with_replaced_words(spark):
    rng = random.Random(11)
    word = lambda: f"k{rng.randrange(20_000)}"
    items = [[word() for _ in range(40)] for _ in range(150)]
    rows = [(i, " ".join([word() for _ in range(50)] + [w if rng.random() > 0.15 else word() for w in item] + [word() for _ in range(50)])) for i, item in enumerate(items)]
    rows += [(1000 + i, " ".join(word() for _ in range(150))) for i in range(50)]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.findings(docs, tests).collect()}
    assert got <= {(i, i) for i in range(150)} and len(got) >= 0.95 * 150


def test_passages(spark, odd):
    rng = random.Random(9)
    fresh = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    p = fresh(70)
    fuzzy = [w if i % 12 else f"q{i}" for i, w in enumerate(p)]
    rows = [(0, fresh(50) + p + fresh(20)), (1, fresh(10) + p), (2, fresh(5) + fuzzy[:35] + ["in", "sert"] + fuzzy[35:] + fresh(9)), (3, fresh(90))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(4, None), (None, " ".join(p))], "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.src_doc_id) for r in got} >= {(1, 0), (2, 0)} and {r.doc_id for r in got} == {1, 2}
    one = next(r for r in got if r.doc_id == 1)
    assert (one.first_word, one.n_words, one.src_first_word, one.share_equal) == (10, 70, 50, 1.0)
    assert passages.repeated_passages(empty(odd)).count() == 0


def best_chains(at, to):
    """Best score of a chain that ends at each match, by trying all predecessors."""
    out = {}
    for i in sorted(range(len(at)), key=lambda i: at[i]):
        near = [j for j in out if 0 < at[i] - at[j] <= passages.LONGEST_GAP and 0 < to[i] - to[j] <= passages.LONGEST_GAP]
        out[i] = passages.K + max([0.0, *(out[j] - passages.GAP_COST * (at[i] - at[j] + to[i] - to[j]) for j in near)])
    return out


@pytest.mark.parametrize("seed", range(40))
def test_chains_of_several_passages(seed):
    rng = random.Random(seed)
    matches, x = set(), 0
    for y in rng.sample(range(0, 3000, 500), rng.randrange(1, 5)):
        x += rng.randrange(1, 600)
        for _ in range(rng.randrange(2, 60)):
            matches.add((x, y))
            x, y = x + rng.randrange(1, 12), y + rng.randrange(1, 12)
    matches |= {(rng.randrange(x), rng.randrange(3500)) for _ in range(rng.randrange(80))}
    matches = sorted(matches, key=lambda _: rng.random())
    at, to = [m[0] for m in matches], [m[1] for m in matches]
    got, best = passages.chains(at, to), best_chains(at, to)
    assert sorted(i for c in got for i in c) == list(range(len(at)))
    cost = lambda i, j: passages.GAP_COST * (at[j] - at[i] + to[j] - to[i])
    for c in got:
        assert all(0 < at[j] - at[i] <= passages.LONGEST_GAP and 0 < to[j] - to[i] <= passages.LONGEST_GAP for i, j in zip(c, c[1:]))
    whole = passages.K * len(got[0]) - sum(cost(i, j) for i, j in zip(got[0], got[0][1:]))
    assert whole == pytest.approx(max(best.values()))


def test_chains_in_line_are_the_best_ones():
    import numpy as np

    rng = random.Random(21)
    for _ in range(300):
        n = rng.randrange(1, 40)
        at, to = (np.cumsum([rng.choice([1, 2, 9, 30, 60, 61, 90]) for _ in range(n)]) for _ in range(2))
        got = sorted((a, b) for a, b in passages.in_line(at, to))
        x, y = at.tolist(), to.tolist()
        assert got == sorted(([x[i] for i in c], [y[i] for i in c]) for c in passages.chains(x, y))
    assert passages.in_line(np.array([1, 2]), np.array([5, 5])) is None


@pytest.mark.parametrize("gap", [50, 70, 300, 5000])
def test_chains_behind_a_long_gap(gap):
    first, second = list(range(0, 500, 6)), list(range(500 + gap, 700 + gap, 6))
    got = passages.chains(first + second, first + second)
    assert sorted(len(c) for c in got) == (sorted([len(first), len(second)]) if gap > 60 else [len(first) + len(second)])


def test_several_passages_a_pair(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"g{rng.randrange(10**6)}" for _ in range(n)]
    p, q, r = fresh(200), fresh(60), fresh(60)
    rows = [(0, p + fresh(90) + q + fresh(300) + r), (1, p + fresh(90) + q + fresh(90) + r), (2, r + fresh(80) + q), (3, p[:100] + fresh(80) + p[100:])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(g.doc_id, g.first_word, g.n_words, g.src_first_word) for g in passages.repeated_passages(docs).collect()}
    assert got == {(1, 0, 200, 0), (1, 290, 60, 290), (1, 440, 60, 650), (2, 0, 60, 650), (2, 140, 60, 290), (3, 0, 100, 0), (3, 180, 100, 100)}


def test_chat(spark):
    got = {r.conv_id: r for r in chat.op9_chat_prefix_target(spark, DIR).collect()}
    turns = duckdb.sql(f"select conv_id, role, coalesce(text, '') from '{DIR}/conversations.parquet' order by conv_id, turn").fetchall()
    by = collections.defaultdict(list, {-7: [("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)]})
    for c, role, text in turns:
        by[c].append((role, text))
    assert set(got) == set(by)
    for c, mine in by.items():
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    odd = spark.createDataFrame([(None, None, None, None), (1, 1, "assistant", "a\\<"), (1, 1, "assistant", "a\\<"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert sorted((r.n_turns, r.loss_chars) for r in chat.read_back(chat.expand(odd)).collect()) == [(1, 0), (1, 0), (2, 6)]
    assert chat.read_back(chat.expand(odd.limit(0))).count() == 0


def test_media(spark, odd):
    got = media.media_features(odd).collect()
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert len(got) == odd.count()
    for doc_id, text in texts:
        n, payload = media.payload_of(text)
        want = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert want in [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got if r.doc_id == doc_id]
    assert media.media_features(empty(odd)).count() == 0


def test_media_is_read_from_the_store(spark, odd):
    rng = random.Random(4)
    texts = [" ".join(f"m{rng.randrange(10**6)}" for _ in range(900)) for _ in range(4)]
    texts += [texts[0], texts[1] + texts[2], "short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, shared = media.chunk_store(docs)
    stored = [r.digest for df in (rows.select(F.explode("own.digest").alias("digest")), shared.select("digest")) for r in df.collect()]
    assert sorted(stored) == sorted({name for t in texts for name, _ in media.chunks_of(media.payload_of(t)[1])})
    got = {r.doc_id: r for r in media.read_back(rows, shared).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):  # the contract's columns, and this store's form, in plain steps
        data = (text or "").encode()
        data += b"\xff" * (-len(data) % 576 or (0 if data else 576))
        ends = media.cuts(data)
        parts = [data[a:b] for a, b in zip([0, *ends], ends)]
        form = b"".join(hashlib.blake2b(p, digest_size=16).digest() + len(p).to_bytes(4, "big") for p in parts) + data
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].media_bytes) == (len((text or "").encode()), len(data), len(form))
        assert (got[i].payload_sha256, got[i].media_sha256, got[i].tail_crc32) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(form).hexdigest(), zlib.crc32(data[-32:]))
        assert got[i].feature.startswith(f"chunks={len(parts)};longest={max(map(len, parts))};mean={sum(data) / len(data):.6f};")
    assert got[0].feature == got[4].feature and rows.filter("not whole").count() >= 5
    lone = media.digest(media.payload_of("short")[1])
    for broken in (rows.withColumn("own", F.when(F.col("payload") == lone, F.array().cast(rows.schema["own"].dataType)).otherwise(F.col("own"))),
                   rows.withColumn("own", F.transform("own", lambda c: c.withField("bytes", F.when(F.col("payload") == lone, F.lit(b"other")).otherwise(c["bytes"]))))):
        with pytest.raises(Exception, match="digest|KeyError"):
            media.read_back(broken, shared).collect()
    with pytest.raises(Exception, match="KeyError"):
        media.read_back(rows, shared.limit(0)).collect()


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 16_384, 40_000])
def test_chunk_ends_against_plain_steps(n):
    data = random.Random(n).randbytes(n)
    ends, at = [], 0
    while at < n:
        h = 0
        for i in range(at, min(at + media.MOST, n)):
            h = sum(int(media.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 31), i + 1)) & 0xFFFFFFFF if i - at >= media.LEAST - 1 else 0
            if i - at >= media.LEAST - 1 and h >> (32 - media.MASK_BITS) == 0 and n - at > media.LEAST:
                break
        at = i + 1
        ends.append(at)
    assert media.cuts(data) == ends


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, DIR).toPandas()
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert 0 < len(out) <= len(kept) and out.doc_id.is_unique
    items = {i: " ".join(re.findall(r"[^\W_]+", t.lower())) for i, t in duckdb.sql(f"select item_id, text from '{DIR}/benchmark.parquet'").fetchall()}
    leaked = {d for d, t in kept.items() if any(x in " ".join(re.findall(r"[^\W_]+", t.lower())) for x in items.values())}
    assert not leaked & set(out.doc_id)


def test_unit_links_join_as_all_pairs_do():
    import numpy as np

    rng = random.Random(3)
    for two in (False, True):
        base = rng.sample(range(10**6), 60)
        sets = [np.array(sorted({x if rng.random() > 0.08 else rng.randrange(10**6) for x in base} | set(rng.sample(range(10**6), rng.randrange(4))))) for _ in range(40)]
        sides = np.array([two * (i % 2) for i in range(40)])
        links = neardup.unit_links(np.arange(40), np.arange(40), sides, sets)
        like = [(i, j) for i in range(40) for j in range(i) if (not two or (i + j) % 2) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

        def parts(pairs):
            low = list(range(40))
            for _ in range(40):
                for i, j in pairs:
                    low[i] = low[j] = min(low[i], low[j])
            return low

        assert parts(links) == parts(like) and len(links) == len({*range(40)}) - len(set(parts(like)))


def test_neardup_of_rows_with_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b + " x"), (2, b), (None, a), (4, None), (4, None), (5, a.upper())], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.classes(docs, 2).collect() if r.doc_id is not None)
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (5, 1, False)]
    assert sorted(((r.doc_id or 0, r.text or "") for r in neardup.keep_one(docs, 2).collect())) == sorted([(1, a), (2, b), (0, a), (4, "")])


def test_passage_whose_parts_stand_in_earlier_documents(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"h{rng.randrange(10**6)}" for _ in range(n)]
    p = fresh(70)
    texts = [fresh(30) + part + fresh(30) for part in (p[:27], p[22:49], p[44:])] + [fresh(30) + p + fresh(30), fresh(12) + p, fresh(40)]
    docs = spark.createDataFrame([(i, " ".join(w), 1, "z") for i, w in enumerate(texts)] + [(4, " ".join(texts[5]), 1, "z"), (None, " ".join(p), 1, "z")], "doc_id long, text string, k int, d string")
    got = [(r.doc_id, r.src_doc_id, r.first_word, r.n_words) for r in passages.repeated_passages(docs).collect()]
    assert (4, 3, 12, 70) in got and all(r[0] == 4 or r[3] < 70 for r in got)
    left = {(r.doc_id, r.text) for r in passages.drop_passages(docs).collect()}
    assert passages.drop_passages(docs).columns == docs.columns and len(left) == len(texts) + 2
    assert (4, " ".join(texts[4][:12]) + " ") in left and (3, " ".join(texts[3])) in left and (None, " ".join(p)) in left and (4, " ".join(texts[5])) in left


@pytest.mark.parametrize(("share", "exact"), [(0.1, False), (0.15, True)])
def test_recall_of_passages_with_replaced_words(spark, share, exact):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(20_000)}"
    rows = []
    for _ in range(120):
        p = [word() for _ in range(60)]
        gone = set(rng.sample(range(60), round(60 * share))) if exact else {i for i in range(60) if rng.random() < share}
        for q in (p, [word() if i in gone else w for i, w in enumerate(p)]):
            rows.append((len(rows), " ".join([word() for _ in range(rng.randrange(200))] + q + [word() for _ in range(40)])))
    got = {(r.doc_id, r.src_doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((i + 1, i) in got for i in range(0, len(rows), 2)) >= 0.9 * len(rows) / 2 and all(a == b + 1 for a, b in got)


@pytest.mark.parametrize("seed", range(10))
def test_widest_chains_against_all_pairs(seed):
    rng = random.Random(seed)
    found = []
    for src in range(40):
        at = sorted(rng.sample(range(rng.choice([30, 200, 1000])), rng.randrange(2, 9)))
        found.append((src, at, at))
    want = []
    for c in sorted(found, key=lambda c: (-len(c[1]), c[1][0], c[0])):
        if not any(w[1][0] <= c[1][0] and c[1][-1] <= w[1][-1] for w in want):
            want.append(c)
    assert passages.widest(found) == want


def plain_scan(text):
    """All matches of all rules by plain loops; hidden ones (inside another of at least their priority) left out."""
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    joined = "".join(f"{w} " for w in words)
    every = []
    for i, (label, _, expr, priority) in enumerate(licenses.rules()):
        for m in regex.finditer(rf"(?<![^ ])(?:{expr})(?= )", joined):
            first = joined[: m.start()].count(" ")
            every.append((first, first + m[0].count(" "), priority, i, label))
    every.sort(key=lambda m: (m[0], -m[1], -m[2], m[3]))
    return [(i, a, b) for k, (a, b, p, i, _) in enumerate(every) if not any(x <= a and b <= y and q >= p for x, y, q, *_ in every[:k])]


def test_licenses_in_tagged_expressions(spark):
    want = {"SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc", "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC": "apache-2.0,isc,mit", "under GPL v2": "gpl-2.0", "the isc and mit": "",
            "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": "apache-2.0", "Neither the name of the Example Corp. nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause"}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()] == list(want.values())


def test_very_many_matches(spark):
    """Linear in the matches of a text; the groups of matches don't show."""
    import time

    df = spark.createDataFrame([(1, "mit license " * 100_000), (2, "licensed under the mit license, " * 3000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert time.time() - began < 60 and (got[1].n_base, got[1].first_word, got[1].last_word, len(got[1].found)) == (100_000, 0, 199_998, 100_000)
    assert [(m.first, m.last) for m in got[2].found] == [(5 * i, 5 * i + 4) for i in range(3000)]


def test_licenses_against_plain_loops(spark):
    rng = random.Random(13)
    titles = ["apache software license version 2 0", "mit license", "GNU Lesser General Public License v2.1", "general public license version 3", "BSD 3 clause license", "CC BY-SA 4.0", "gplv3", "mozilla public license 2.0",
              "SPDX-License-Identifier: MPL-2.0", "all rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy", "licensed under the terms of the", "(c) Copyright 2019", "either version 2 of the license, or (at your option) any later version", "creative commons attribution 4.0", "zlib license", "ISC", "und für", "public domain"]
    texts = [rng.choice([" ", "\n", "-", ", "]).join(rng.choice(titles) if rng.random() < 0.6 else "some words" for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    texts += [" ".join(titles * 40), *(f"x {name} y" for _, _, _, names in licenses.LICENSES for name in names)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("present", F.lit(2))
    for r in licenses.scan(df).collect():
        assert sorted((m.rule, m.first, m.last) for m in r.found) == sorted(plain_scan(texts[r.doc_id])), texts[r.doc_id]


def test_holder_before_is_exact_for_seeds_with_many_places(spark, monkeypatch):
    common = " ".join(f"c{i}" for i in range(50))
    docs = spark.createDataFrame([(7 * i * i, f"own{i} " * 3 + common + f" tail{i}") for i in range(40)], "k long, text string")
    found = lambda: sorted((r.k, r.src, r.m.at, r.m.to) for r in passages._matches(docs).collect())
    want = found()
    monkeypatch.setattr(passages, "HOT", 6)
    got = found()
    assert got == want
    assert {(7 * i * i, 7 * (i - 1) ** 2) for i in range(2, 40)} <= {m[:2] for m in got}


def test_slots_give_the_ranks_of_all_pairs():
    model = pieces.Pieces.load()
    at = next(i for i in range(1, len(model.pair_keys)) if model.slot_shared[model._slot(model.pair_keys[i : i + 1])[0]])
    left, right = model.pair_keys // model.stride, model.pair_keys % model.stride
    assert (model._rank_of(left[1:], right[1:]) == model.pair_ranks[1:]).all() and at
    known = set(model.pair_keys.tolist())
    a, b = np.array([-1, *range(300, 1300)]), np.array([5, *range(1400, 400, -1)])
    got = model._rank_of(a, b)
    assert [g == pieces.NONE for g in got.tolist()] == [x < 0 or x * model.stride + y not in known for x, y in zip(a.tolist(), b.tolist(), strict=True)]
