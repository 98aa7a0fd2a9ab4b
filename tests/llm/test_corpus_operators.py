"""The corpus operators against brute force, with odd rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.llm import chat, decontamination, embedding_lsh, language, licenses, mixture, ngram_join, secrets, toxicity, urls
from folioflux.llm.common import components, fold
from folioflux.llm.queries import ORACLE, QUERIES

EMPTY = "doc_id long, text string, lang string, source string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = (text or "").translate(UP).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70), (None, 3), (90, 80)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 60: 50, 80: 80, 90: 80}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = union_find({d for d, _ in sets if d is not None}, linked)
    got = ngram_join.classes(docs).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted([(d, len(s), want.get(d)) for d, s in sets], key=key)
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d in want if want[d] == d} | {None}
    assert ngram_join.classes(spark.createDataFrame([], EMPTY)).count() == 0


def test_ngram_join_large_group(spark):
    words = [f"a{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 50], f"x{i}", *words[i % 50 :]])) for i in range(120)]
    got = {r["component_id"] for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_bitmap_bound_is_an_upper_bound():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64))))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        bound = ngram_join.overlap_bound(int.from_bytes(x, "little"), 8 * len(x), len(a), int.from_bytes(y, "little"), 8 * len(y), len(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((150, 16))
    v[50:80] = v[:30] + rng.standard_normal((30, 16)) * 0.05
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)]
    rows += [(150 + k, rows[5][1], 1) for k in range(40)]  # copies
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0, None] + [0.0] * 14, 1), (203, [float("nan")] * 16, 1), (204, [], 1), (205, [1.0, 2.0], 1), (None, rows[5][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls int")
    f = np.array([np.array(r[1], np.float32).astype(float) for r in rows[:190]])
    cos = (f @ f.T) / np.outer(np.linalg.norm(f, axis=1), np.linalg.norm(f, axis=1))
    a, b = np.nonzero(np.triu(cos >= 0.9, 1))
    want = union_find(range(206), list(zip(a.tolist(), b.tolist(), strict=True)))
    for tile in (2048, 3):
        got = embedding_lsh.classes(frame, recall=0.9999, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            if i is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            else:
                n = int((cos[i] >= 0.9).sum()) - 1 if i < 190 else 0
                assert (r["n_links"], r["component_id"], r["kept"]) == (n, want[i], want[i] == i)
    assert embedding_lsh.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_recall(spark):
    """Pairs right at the threshold are found as often as wanted."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal((1500, 32))
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * other
    hashes, tables = embedding_lsh.shape(3000)
    x, y = embedding_lsh.buckets(a, hashes, tables), embedding_lsh.buckets(b, hashes, tables)
    assert (x == y).any(1).mean() >= 0.95


def test_mixture(spark, docs):
    rows = mixture.plan(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == collections.Counter((r["doc_id"], size(r["text"])) for r in docs.collect())
    total, sources = 0, collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        total += r["size"]
        s = sources[r["source"]]
        s[0] += r["size"]
        s[1] += r["taken"]
        s[2] = r["target"]
        assert r["taken"] == sum(p["words"] for p in r["passes"]) and all(0 <= p["position"] <= 1 for p in r["passes"])
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    left, open_, goal = float(total), list(order), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * sources[s][0]]
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            goal[s] = 3.0 * sources[s][0]
            left -= goal[s]
            open_.remove(s)
    for s in order:
        assert sources[s][2] == pytest.approx(goal[s]) and abs(sources[s][1] - goal[s]) <= 1
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixture.plan(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in rows}
    mixed = mixture.mix(docs).collect()
    assert [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)
    assert mixture.plan(spark.createDataFrame([], EMPTY)).count() == 0


def test_demand_inverse(spark):
    share = [i / 20 for i in range(21)]
    for a in (0.5, -0.5, 0.0):
        frame = spark.createDataFrame([(s,) for s in share], "s double")
        got = [r[0] for r in frame.select(mixture.demand_inverse(F.col("s"), F.lit(a))).collect()]
        assert all(abs((1 + a) * t - a * t * t - s) < 1e-9 for t, s in zip(got, share, strict=True))


def by_windows(text):
    """Labels and largest containment by intersecting every block with every template."""
    w, found, most = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP)), set(), 0.0
    for label, template, naming in licenses.TEMPLATES:
        tokens = set(template.split())
        for k in range(len(w)):
            block = set(w[k : k + licenses.width(template)])
            if len(tokens & block) >= licenses.need(len(tokens)) and set(naming.split()) <= block:
                found.add(label)
                most = max(most, len(tokens & block) / len(tokens))
    return found, most


def test_licenses(spark, docs):
    extra = [(200, "Released under the MIT License.\nMIT license, mit LICENSE!", "en", "s"), (201, "MIT. Something\nApache_License", "en", "s"), (202, "general public licenses general-Public license mit\nlicense", "en", "s"), (203, "foo\nLicensed under CC BY-NC 4.0.", "en", "s"), (204, "é mité license mit license", "en", "s")]
    frame = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame(extra, EMPTY).select("doc_id", "text", F.lit(1).cast("long").alias("n")))
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(frame).collect()}
    for r in frame.collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r["text"] or "").translate(UP))
        want = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        x = got[r["doc_id"], len(w)]
        assert sorted((p["start"], p["label"]) for p in x["places"]) == want
        assert (set(x["found"]), x["most"]) == by_windows(r["text"])
    assert licenses.scan(spark.createDataFrame([], EMPTY)).count() == 0


ASSIGN = re.compile(secrets.ASSIGN, re.A)


def test_secrets(spark, docs):
    key = "AKIA" + "A1" * 8
    texts = ["token = \"abcdef0123\" password=token: abcdefgh", f"é {key} {key}X AKIASHORT", "f" * 23 + " " + "0" * 24, "secret:x PASSWORD: 'hunter22' api-key=no api_key=yes123", f"id {key}\n blob Zx9" + "Qw3rTy" * 5, "blob Zx9" + "Qw3rTy" * 5, "see https://db.example.org/x then Zx9" + "Qw3rTy" * 5 + " " * 700 + "Zz9" + "Qw3rTy" * 5]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(300 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    seen = collections.Counter()
    for r in secrets.scan(frame).collect():
        seen[r["doc_id"]] += 1
    assert seen == collections.Counter(r["doc_id"] for r in frame.collect())
    got = {r["doc_id"]: r for r in secrets.scan(frame).collect()}
    for r in frame.collect():
        t = r["text"] or ""
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s["start"], s["rank"], s["end"]) for s in got[r["doc_id"]]["strong"]] == sorted(want)
    assert [len(got[300 + i]["linked"]) for i in range(7)] == [0, 0, 0, 0, 1, 0, 0]
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(frame).collect()}
    assert clean[301].startswith("é [SECRET] [SECRET] AKIASHORT") and "Qw3r" not in clean[304] and "Qw3r" in clean[305]
    assert clean[0] == frame.where("doc_id = 0").first()["text"] and clean[90] is None
    assert secrets.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_urls(spark):
    found = ["https://A.Example.ORG/es/x", "http://example.org/en/100", "http://example.org", "http://org/", "ftp://b.com/fr/", "http://b.com/de/?q", "x://evil-example.org/es/", None, "no scheme", "", "http://casino.net/", "http://x.casino-win.net", "http://b.com/FR/", "http://example.org:80/es/", "http://b.com/fr/", "http://b.com/fr/"]
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(found)] + [(1, found[1], "h", "r")], "page_id long, url string, host string, rule string")
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(frame).collect())
    want = collections.Counter()
    for r in frame.collect():
        rest = (r["url"] or "").partition("://")[2] if "://" in (r["url"] or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], host.translate(UP)
        fits = [(len(n), n, v) for v, n in urls.RULES if (host == n.partition("/")[0] or host.endswith("." + n.partition("/")[0])) and path.startswith("/" + n.partition("/")[2])]
        block = host and re.search(r"(^|[.-])casino[.-]", host)
        want[r["page_id"], host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if block else "allow"] += 1
    assert got == want
    assert urls.judge(frame.limit(0)).count() == 0


def test_language(spark, docs):
    model = language.fit(docs)
    assert set(model) == {"en", "de", "fr"}
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (90, 91, 92))
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = language.filtered(docs, model)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in rows if r["accepted"])
    assert language.predict(spark.createDataFrame([], EMPTY), {}).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_language"](spark, d).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("truth"))
    got = QUERIES["op3_chat"](spark, d).join(turns, ["conv_id", "turn"]).where("held_out").collect()
    assert sum(r["role"] == r["truth"] for r in got) >= 0.9 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["conv_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity(spark, docs):
    bad = [(500 + i, f"you are a stupid idiot {i} and scum w{i}") for i in range(30)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(bad, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(500 + i, 1) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame.where(fold("doc_id", 3) != 1), labels.where(fold("doc_id", 3) != 1))
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == frame.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["predicted"] == int(r["doc_id"] is not None and r["doc_id"] >= 500) for r in rows if r["doc_id"] is not None)
    flat = toxicity.fit(frame, labels.where("toxic = 9"))
    assert {r["predicted"] for r in toxicity.score(frame, flat).collect()} == {0}


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(200)
    y = (rng.random(200) < 1 / (1 + np.exp(-3 * x))).astype(float)
    knots, p = toxicity.isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(p) >= 0).all() and 0 < p.min() and p.max() < 1


def test_decontamination(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    long = [r["text"] for r in rows if r["text"] and 20 < len(r["text"].split()) < 90]
    items = [(i, " ".join(t.split()[3:18])) for i, t in enumerate(long[:15])] + [(50, None), (51, ""), (52, "nothing of this kind stands anywhere in any of the documents here"), (53, "One two")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    want = collections.Counter()
    for r in rows:
        w = decontamination.tokens(r["text"])
        for item, text in items:
            part = decontamination.tokens(text)
            if part:
                s = decontamination.shingles(part)
                here = {tuple(w[i : i + len(next(iter(s)))]) for i in range(len(w))}
                q, a = (decontamination.shingles(x) for x in decontamination.split(text))
                share = lambda x: len(x & {tuple(w[i : i + len(next(iter(x)))]) for i in range(len(w))}) / len(x) if x else 1.0  # noqa: B023, E731
                if len(s & here) >= 0.75 * len(s) and share(q) >= 0.5 and share(a) >= 0.5:
                    want[r["doc_id"], item] += 1
    assert sum(want.values()) >= 15
    for limit in (400_000, 20):  # one shard, and many
        got = decontamination.matches(docs, bench, max_postings=limit).collect()
        assert collections.Counter((r["doc_id"], r["item_id"]) for r in got) == want
    small = bench.select(F.col("item_id").cast("smallint").alias("item_id"), "text")
    assert decontamination.matches(docs, small).count() == sum(want.values())
    kept = decontamination.cleaned(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows} - {d for d, _ in want if d is not None}
    assert decontamination.matches(docs, bench.limit(0)).count() == 0
    assert decontamination.matches(spark.createDataFrame([], EMPTY), bench).count() == 0


def test_wand_finds_what_full_scoring_finds():
    rng = np.random.default_rng(2)
    n, terms = 200, 60
    weights = {t: [(int(i), float(w)) for i, w in zip(sorted(rng.choice(n, 40, replace=False)), rng.random(40) * 0.2, strict=True)] for t in range(terms)}
    band = decontamination.Band(16, {t: list(p) for t, p in weights.items()}, n, terms)
    for _ in range(60):
        query = rng.choice(terms, 12, replace=False).tolist()
        score = collections.Counter()
        for t in query:
            for i, w in weights[t]:
                score[i] += w
        for low, high in ((0, n), (50, 120)):
            want = {i: s for i, s in score.items() if s >= 0.45 and low <= i < high}
            got = dict(band.search(query, low, high, 0.45))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_chat(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        for t in range(6):
            role = ["user", "assistant"][t % 2]
            body = "word " * int(rng.integers(2, 8) if role == "user" else rng.integers(30, 60))
            rows.append((c, t, role, ("User: " if role == "user" and c % 3 == 0 else "") + body, 1))
    rows += [(7, 6, None, None, 1), (7, 7, None, "", 1), (None, 1, None, "Assistant: hi", 1), (8, None, None, "User: hi?", 1), (9, 5, "assistant", "word " * 40, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
    model = chat.fit(frame)
    got = chat.decoded(frame, model).collect()
    assert len(got) == len(rows)
    truth = {(r[0], r[1]): r[2] for r in rows}
    assert np.mean([r["role"] == truth[r["conv_id"], r["turn"]] for r in got if truth[r["conv_id"], r["turn"]]]) >= 0.95
    assert next(r for r in got if r["conv_id"] is None)["rendered"] == "<|assistant|>\nhi\n<|end|>"
    order = lambda rs: sorted((str(r["conv_id"]), str(r["turn"]), r["role"]) for r in rs)
    assert order(chat.decoded(frame, model, chunk=2).collect()) == order(got)
    assert {r["role"] for r in chat.decoded(frame, {"roles": []}).collect()} == {None}
    assert order(chat.decoded(frame.withColumn("turn", F.col("turn").cast("smallint")), model).collect()) == order(got)
    long = chat.decoded(spark.createDataFrame([(1, 1, "User: " + "x " * 400_000 + "?"), (1, 2, "y")], "conv_id long, turn long, text string"), model).collect()
    assert len(long) == 2 and max(len(r["rendered"]) for r in long) > 800_000
    assert chat.decoded(frame.limit(0), model).count() == 0
    assert [r["text"].strip() for r in chat.lines(spark.createDataFrame([(1, "User: a\nb\nAssistant: c")], "doc_id long, text string")).orderBy("turn").collect()] == ["User: a\nb", "Assistant: c"]


def test_viterbi_against_every_path():
    rng = np.random.default_rng(6)
    model = {"start": np.log(rng.dirichlet(np.ones(3))), "move": np.log(rng.dirichlet(np.ones(3), 3))}
    for n in (1, 2, 5):
        for entry in (None, 0, 2):
            for exit_ in (None, 1):
                e = np.log(rng.dirichlet(np.ones(3), n))

                def cost(path, e=e, entry=entry):
                    first = model["start"][path[0]] if entry is None else model["move"][entry, path[0]]
                    return first + e[0, path[0]] + sum(model["move"][a, b] + e[k + 1, b] for k, (a, b) in enumerate(zip(path, path[1:])))

                paths = [p for p in itertools.product(range(3), repeat=n) if exit_ is None or p[-1] == exit_]
                assert cost(chat.best_path(model, e, entry, exit_)) == pytest.approx(max(map(cost, paths)))


def test_boosted_trees_lower_the_loss():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    p = 1 / (1 + np.exp(-toxicity.margin(toxicity.boost(x[:400], y[:400]), x[400:])))
    assert np.mean((p > 0.5) == y[400:]) > 0.93
    one = toxicity.boost(x[:50], y[:50], rounds=1, depth=1)
    feature, cut, _, value = one["trees"][0]
    base = y[:50].mean() * 50 / 52 + 1 / 52
    assert one["base"] == pytest.approx(np.log(base / (1 - base)))

    def gain(j, c):
        g, h, left = base - y[:50], np.full(50, base * (1 - base)), x[:50, j] <= c
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
        return part(left) + part(~left)

    best = max(gain(j, c) for j in range(3) for c in np.unique(np.quantile(x[:50, j], np.linspace(0, 1, 33)[1:-1])))
    assert gain(feature[0], cut[0]) == pytest.approx(best) and feature[1] == feature[2] == -1


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
