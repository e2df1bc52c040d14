"""Mixing, token alignment and conversation repair: small tables with nulls, empty and long texts, ties, repeated rows and
clashing columns, against SQL or plain loops."""

import collections
import hashlib
import itertools
import os
import random
import re

import duckdb
import pytest

from tessera.llm import alignment, mixing, registry, repair

DIR = "/root/testdata/sf0.001"


def rows_of(table):
    return sorted(tuple(map(str, (r[c] for c in sorted(r)))) for r in table.to_pylist())


def same_as_sql(got, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got, want = got.toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


# ---- mixing


def mixture(df):
    from pyspark.sql import functions as F

    return mixing.mix(df).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def documents(spark, rng, sources, n):
    words = lambda: " ".join(rng.choices(["a", "bb", "é", "　", "漢"], k=rng.choice([0, 1, 3, 40, 400])))
    rows = [(rng.choice([None, i, i, i]), rng.choice([None, "", words(), words(), words()]), rng.choice(sources), i, "x") for i in range(n)]
    rows += [rows[0]] * 7 + [(5, "same text " * 9, sources[0], 1, "x")] * 40 + [(6, "long " * 200_000, sources[-1], 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target long, key string")


@pytest.mark.parametrize("sources", [["s"], [None, "", "a", "b"], [f"s{i}" for i in range(30)] + [None]])
def test_mixing_equals_sql(spark, sources):
    df = documents(spark, random.Random(len(sources)), sources, 300)
    same_as_sql(mixture(df), mixing.SQL, documents=df)
    assert mixture(df.limit(0)).count() == 0


def test_mixing_keeps_targets_and_limits(spark):
    got = registry.QUERIES["op11_mixing"](spark, DIR).toPandas()
    by = got.groupby("source", dropna=False)
    assert (got.taken <= 3 * got["size"]).all()
    assert (abs(by.taken.sum() - by.target.first()) <= by["size"].max() / 2 + 1e-6).all()
    assert abs(by.target.first().sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    assert rows_of(registry.QUERIES["op11_mixing"](spark, DIR).toArrow()) == rows_of(registry.QUERIES["op11_mixing"](spark, DIR).toArrow())


def test_mixing_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.target, r.copies * r.size) for r in mixing.mix(df).collect()} == {(0.0, 0)}


def test_mixing_nests(spark):
    """A smaller share takes no row more often than a greater one."""
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    small, large = ({r.doc_id: r.copies for r in mixing.mix(df, share=s).filter("size > 0").collect()} for s in (0.4, 1))
    assert all(n <= large[i] for i, n in small.items()) and sum(small.values()) < sum(large.values())


def test_mixing_with_salted_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    df = documents(spark, random.Random(3), ["a", None, "b"], 200)
    same_as_sql(mixture(df), mixing.SQL, documents=df)


# ---- alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    first = Tokenizer.from_file(alignment.BYTE_MODEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    byte = alignment._byte_of()
    cut = lambda parts: list(itertools.pairwise([0, *itertools.accumulate(map(len, parts))]))
    per, count = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        a_raw = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
        b_raw = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or {b"".join(a_raw), b"".join(b_raw)} != {f" {text}".encode()}:
            per.append((doc_id, [], [], [], []))
            continue
        a_at, b_at = cut(a_raw), cut(b_raw)
        links, j = [], 0
        for i, (s, e) in enumerate(a_at):
            while b_at[j][1] <= s:
                j += 1
            links += [(a[i], b[k]) for k in itertools.takewhile(lambda k: b_at[k][0] < e, range(j, len(b)))]  # noqa: B023
        groups = []
        for low, high in itertools.pairwise([0, *sorted({e for _, e in a_at} & {e for _, e in b_at})]):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if low <= s and e <= high) for ids, at in ((a, a_at), (b, b_at))) if len(a) < 2000 else "")
        count.update(links)
        per.append((doc_id, a, b, groups, links))
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((d, len(a), len(b), len(g), len(x), sum(count[y] == top[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a and len(a) < 2000 else "" if not a else None) for d, a, b, g, x in per), key=str)


ODD = [(None, "a"), (-1, None), (-2, ""), (-3, " "), (-4, "▁x"), (-5, "<|endoftext|> <s> </s> <unk> <0x41>"), (-6, "  two  spaces\n\n x y "), (-7, "x  y 　 z"), (-8, "é" * 50 + " 漢字 😀"), (-9, "\x00\x01 \x1f x"), (-10, "a\x1c b"), (-11, "don't  can't 's"), (-11, "don't  can't 's"), (-12, "tab\t x \r\n y"), (-13, "café ﬁ ① ½"), (-14, "x​ y ﻿ z"), (-15, "a" * 3000), (-16, "the cat " * 40_000)]


@pytest.mark.parametrize("most", [alignment.BLOCK_CHARS, 3000])
def test_alignment(spark, most):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(60).collect()] + ODD
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, n_a long, block long, kind string").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df, most=most).collect()), key=str)
    want = brute_alignment(rows)
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=lambda r: str(r[:7])), sorted(want, key=lambda r: str(r[:7])), strict=True):
        assert x[:7] == y[:7] and (y[7] is None or x[7] == y[7])
    assert alignment.align(df.limit(0)).count() == 0


def test_group_text_is_the_stated_form(spark):
    df = spark.createDataFrame([(1, "hello unusualness")], "doc_id long, text string")
    passages = alignment.Passages(alignment.tokenizers())
    passages.numbers("hello unusualness")
    passages.align()
    text = ";".join(passages.groups)
    assert re.fullmatch(r"\d+(,\d+)*\|\d+(,\d+)*(;\d+(,\d+)*\|\d+(,\d+)*)*", text)
    assert alignment.align(df).first().groups_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---- repair


def brute_repair(signature, most_inserts):
    """Least (cost, edits) over all sequences of edits."""
    best = None

    def go(i, left, cost, edits, roles):
        nonlocal best
        if i == len(signature) and re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, edits) < best):
            best = cost, edits
        if left:
            for r in "ua":
                go(i, left - 1, cost + 2, edits + "I", roles + r)
        if i < len(signature):
            sign = signature[i]
            go(i + 1, left, cost + 3, edits + "D", roles)
            if sign != "x":
                extra, role = sign.isupper(), sign.lower()
                go(i + 1, left, cost + extra, edits + "K", roles + role)
                for r in "ua":
                    go(i + 1, left, cost + 2 + extra, edits + "R", roles + r)

    go(0, most_inserts, 0, "", "")
    return best


def test_program_against_all_edits():
    signatures = ["".join(x) for n in range(4) for x in itertools.product("suaoxUA", repeat=n)]
    path, layers = "", [repair.first_layer()]
    for s in sorted(signatures):
        shared = len(os.path.commonprefix((path, s)))
        del layers[shared + 1 :]
        for sign in s[shared:]:
            layers.append(repair.step(layers[-1], sign))
        path = s
        assert repair.terminal(s, layers) == brute_repair(s, 3), s


def conversations(spark, rng, n):
    texts = ["Fine.", "Fine.", "Well", "", " \t", "Is it? ", "No!\n", None, "x ", "...", "ok."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"]
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}.", 1, "x") for _ in range(n * 7)]
    rows += [(n, t, ("user", "assistant")[t % 2], f"{t}.", 1, "x") for t in range(700)] + [(n + 1, 0, "user", "long " * 100_000, 1, "x")] + [rows[0]] * 3
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost long, audit string").repartition(3)


def test_repair_equals_sql(spark):
    for k in range(2):
        df = conversations(spark, random.Random(k), 60)
        same_as_sql(repair.repair(repair.damage(df)), repair.SQL, conversations=df)
    assert repair.repair(repair.damage(df.limit(0))).count() == 0


def test_repair_of_a_dropped_conversation(spark):
    import zlib

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert tuple(repair.repair(repair.damage(df)).first()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_with_a_shared_signature(spark):
    """Most conversations alike: each is answered, over many partitions."""
    df = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(800) for t in range(4)], "conv_id long, turn long, role string, text string")
    same_as_sql(repair.repair(repair.damage(df)), repair.SQL, conversations=df)
