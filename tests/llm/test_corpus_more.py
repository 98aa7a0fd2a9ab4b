"""License blocks over lines, linked credentials and other cases of the corpus operators, against brute force."""

import collections
import random
import time

import duckdb
import pytest
import zstandard

from folioflux.llm import language, licenses, secrets
from folioflux.llm.queries import ORACLE, QUERIES
from test_corpus_operators import by_windows


def test_wrapped_licenses(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation files (the "Software")'
    bsd = "# Redistribution and use in source\n# and binary forms, with or without\n# modification, are permitted provided"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published"
    texts = [mit, bsd, gpl, "Licensed under the Mozilla Public License, Version 2.0", "Licensed under the Apache\n License, Version 2.0", "permission granted " * 50]
    rng = random.Random(1)
    words = sorted({w for t in licenses.TEMPLATES for w in t[1].split()}) + ["x", "y"]
    for _ in range(60):
        t = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                t.insert(rng.randrange(len(t) + 1), rng.choice(words))
            elif len(t) > 1:
                t.pop(rng.randrange(len(t)))
        noise = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
        texts.append(f"{noise()}\n{' '.join(t)} {noise()}")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (set(r["found"]), r["most"]) for r in licenses.scan(frame).collect()}
    assert all(got[i] == by_windows(t) for i, t in enumerate(texts))
    assert [got[i][0] for i in range(6)] == [{"mit"}, {"bsd"}, {"gpl"}, set(), {"apache"}, set()]
    spans = licenses.matches(frame.where("doc_id = 0")).collect()
    assert any(r["start_word"] == 0 and r["containment"] == 1.0 for r in spans)


def same_as_sql(spark, folder, name, tables):
    """A registered query over these tables gives what its SQL gives in DuckDB."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    shown = lambda rows: collections.Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert shown(map(tuple, got.collect())) == shown(want)
    return got


@pytest.mark.parametrize("name", ["op4_ngram_join", "op5_licenses", "op10_secrets"])
def test_odd_rows_against_sql(spark, docs, tmp_path, name):
    rows = docs if name != "op4_ngram_join" else docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    same_as_sql(spark, tmp_path, name, {"documents": rows})


def test_linked_secrets_against_sql(spark, tmp_path):
    rng = random.Random(8)
    token = lambda n: "".join(rng.choice("abcdefXYZ0189+/_-") for _ in range(n))
    makers = [
        lambda: "AKIA" + "".join(rng.choice("ABC123") for _ in range(rng.randint(10, 30))), lambda: f"client_id={token(5)}", lambda: "user_name: bob@example.org", lambda: f"https://h{token(3)}.example.org/p",
        lambda: "hostname=db1.local:5432", lambda: token(rng.randint(15, 200)), lambda: ".".join(token(rng.randint(3, 30)) for _ in range(3)), lambda: f"key {token(30)}", lambda: f"x: '{token(24)}'", lambda: f"conf={token(40)}",
        lambda: f"password={token(9)}", lambda: "API_KEY : " + token(25), lambda: "%040x" % rng.getrandbits(160), lambda: "é 日本 word " * rng.randint(1, 30), lambda: "\n", lambda: "x" * 25, lambda: "1" * 30,
    ]
    texts = ["".join(rng.choice(makers)() + rng.choice([" ", "\n", ", ", ""]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20] + [None, ""])], "doc_id long, text string")
    got = same_as_sql(spark, tmp_path, "op10_secrets", {"documents": frame})
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert sum("weak" in s for s in spans.values()) > 20
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(frame).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if start > at or not out:
                out += [t[at:start], "[SECRET]"]
            at = max(at, end)
        assert clean[i] == ("".join(out) + t[at:] if out else t)
    assert clean[len(texts) + 20] is None


def test_many_secrets_in_a_long_text(spark):
    text = " ".join("%032x" % (i * 7919 + 10**30) for i in range(12_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.monotonic()
    assert len(secrets.scan(frame).first()["strong"]) == 12_000
    assert secrets.redacted(frame).first()["text"] == " ".join(["[SECRET]"] * 12_000)
    assert time.monotonic() - begun < 40


def test_decontamination_against_sql(spark, docs, tmp_path):
    texts = [r["text"] for r in docs.collect() if r["text"] and 20 < len(r["text"].split()) < 90]
    items = [(i, " ".join(t.split()[2 : 9 + i])) for i, t in enumerate(texts[:20])] + [(30, "w1 w2? w3"), (31, None), (32, " ".join(texts[3].split()[:9]) + "? " + " ".join(texts[3].split()[9:20])), (32, "One two")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(400, "a b " * 900 + texts[0]), (401, "x w1 w2 w3 y")], "doc_id long, text string"))
    got = same_as_sql(spark, tmp_path, "op1_decontamination", {"documents": rows, "benchmark": spark.createDataFrame(items, "item_id long, text string")})
    assert got.count() > 20 and got.where("doc_id = 400").count() >= 1


def test_language_against_plain_compression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 1500")
    model = language.fit(docs)
    size = min(map(len, model.values()))
    if any(len(v) < language.NEAR * max(map(len, model.values())) for v in model.values()):
        model = {k: v[:size] for k, v in model.items()}
    common = min(map(len, model.values()))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for r in docs.limit(120).collect():
        data, sizes = r["text"].lower().encode(), {}
        for k, v in model.items():
            held = zstandard.ZstdCompressionDict(v[:common], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=held, write_content_size=False, write_checksum=False)
            sizes[k] = sum(len(c.compress(data[i : i + language.SEGMENT])) for i in range(0, len(data), language.SEGMENT))
        order = sorted(sizes, key=lambda k: (sizes[k], k))
        if sizes[order[0]] >= language.RESOLVED * 1.2:
            assert got[r["doc_id"]]["lang_pred"] == order[0] or sizes[order[1]] - sizes[order[0]] <= 0.02 * sizes[order[0]]


def test_language_pieces_cover_whole_texts(spark):
    text = "a" * 3000 + "b" * 3000 + "c" * 3000
    model = language.fit(spark.createDataFrame([(1, text, "xx"), (2, "short", "yy")], "doc_id long, text string, lang string"))
    assert model["yy"] == b"short" and set(model["xx"]) >= set(b"abc") and len(model["xx"]) == language.PIECES * (language.PIECE + 1) - 1
