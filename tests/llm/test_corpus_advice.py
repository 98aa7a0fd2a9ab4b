
import collections
import random
import time

import pytest

import corpus_pipeline
from folioflux.llm import language, mixture, secrets, toxicity


def test_spaced_letters_in_a_long_text():
    filler = "word " * 50_000
    for text in (f"idiot {filler} i d i o t now", f"i d i o t {filler} idiot"):
        got = dict(zip(toxicity.NAMES, toxicity.features(text, {}), strict=True))
        n = len(toxicity.tokens(text))
        assert len(text) > 250_000 and got["curated"] == 1 / n
        assert got["obfuscated"] == 1 / n and got["revealed"] == 1 / n
    begun = time.monotonic()
    toxicity.features("idiot " + "a_" * 150_000 + "b " * 150_000, {})
    assert time.monotonic() - begun < 20


def test_long_and_dotted_secrets(spark):
    key, token = "AKIA" + "A1" * 8, "Zx9+Qw3rTy/" * 18 + "a="
    jwt = ".".join(["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIn0", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"])
    texts = [f"id {key}\nsession {token} end", f"client_id=web1 bearer {jwt}.", f"see https://db.example.org/x with key {token}.", f"nothing beside {token} {jwt}", f"client_id=web1 {'ab1.' * 20_000}c www.example.org v1.2.3-rc4"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["linked"]] for r in secrets.scan(frame).collect()}
    assert len(token) >= 200 and got == {0: [token], 1: [jwt], 2: [token], 3: [], 4: []}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(frame).collect()}
    assert clean[0] == "id [SECRET]\nsession [SECRET] end" and clean[1] == "client_id=web1 bearer [SECRET]." and clean[3] == texts[3]


def repeated():
    rows = [(7, f"a{i} b c d", "en", "s0") for i in range(4)] + [(8, "x y", "en", "s0")] * 3 + [(None, f"n{i} m", "en", "s1") for i in range(5)]
    return rows + [(i, f"w{i} " * (i % 5 + 1), "en", ["s1", "s2", None][i % 3]) for i in range(10, 60)]


def test_mix_takes_each_row_for_itself(spark):
    frame = spark.createDataFrame(repeated(), "doc_id long, text string, lang string, source string")
    plan, mixed = mixture.plan(frame).collect(), mixture.mix(frame).collect()
    assert len(mixed) == sum(len(r["passes"]) for r in plan)
    assert collections.Counter((r["doc_id"], r["position"], r["words"]) for r in mixed) == collections.Counter((r["doc_id"], p["position"], p["words"]) for r in plan for p in r["passes"])
    assert [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)
    copies = collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert all(n <= 3 * copies[k] for k, n in collections.Counter((r["doc_id"], r["text"]) for r in mixed).items())
    given = collections.Counter()
    for r in mixed:
        given[r["source"]] += r["words"]
    assert all(abs(given[r["source"]] - r["target"]) <= 0.5 + 1e-6 for r in plan)
    assert mixture.mix(frame).columns == [*frame.columns, "position", "words"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    lexicon = {"en": "the house and a river that was with him under old trees", "de": "das haus und ein fluss der mit ihm unter alten bäumen war"}
    text = lambda k, i, n=40: " ".join(rng.choice(lexicon[k].split()) for _ in range(n)) + f" {k}{i}"
    rows = [(i, text(k, i), k, f"s{i % 3}") for i in range(60) for k in [["en", "de"][i % 2]]]
    rows += [(70, "the old house", "en", "s0")] * 2 + [(None, text("en", 90 + i), "en", "s1") for i in range(4)] + [(80, rows[4][1], "en", "s0"), (81, None, "en", "s0"), (82, "12 34", "en", "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    passage = rows[10][1]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = collections.Counter((r[0], r[1]) for r in rows if r[0] not in (80, 81, 82, 10))
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = collections.Counter((r["doc_id"], r["text"]) for r in mixed)
    assert set(got) <= set(want) and all(n <= 3 * want[k] for k, n in got.items())
    size, given = collections.Counter(), collections.Counter()
    for (d, t), n in want.items():
        source = next(r[3] for r in rows if (r[0], r[1]) == (d, t))
        size[source] += n * len(t.split())
    for r in mixed:
        given[r["source"]] += r["words"]
    left, open_, goal = float(sum(size.values())), dict(zip(sorted(size), (5, 2, 1), strict=True)), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 3 * size[s]]
        goal |= {s: 3.0 * size[s] for s in full} if full else {s: level * w for s, w in open_.items()}
        left -= sum(3.0 * size[s] for s in full)
        open_ = {s: w for s, w in open_.items() if full and s not in full}
    assert all(abs(given[s] - goal[s]) <= 0.5 + 1e-6 for s in goal)


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("text is not null")
    return docs, language.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))


def test_scarce_language_leaves_the_others_alone(sample):
    docs, model = sample
    rows = docs.limit(400).collect()
    want = [language.Judge(model, language.MARGIN)(r["text"]) for r in rows]
    for extra in (b"", b"This.", model["en"][5000:7048]):
        got = [language.Judge(model | {"xx": extra}, language.MARGIN)(r["text"]) for r in rows]
        assert sum(a[0] == b[0] and a[3] == b[3] for a, b in zip(got, want, strict=True)) >= 0.98 * len(rows)


def test_one_row_language_keeps_dictionaries(spark, sample):
    docs, model = sample
    more = language.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2").union(spark.createDataFrame([(10**6, "Rara.", "xx")], "doc_id long, text string, lang string")))
    assert more == model | {"xx": b"rara."}


def test_short_documents_have_a_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").where("text is not null")
    model = language.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    rows = [r for r in docs.where("length(text) < 120").collect() if 1 <= len(r["text"].split()) <= 10 and language._LETTER.search(r["text"])]
    judge = language.Judge(model, language.MARGIN)
    got = [judge(r["text"]) for r in rows]
    assert len(rows) > 150
    assert sum(g[3] for g in got) >= 0.95 * len(rows)
    assert sum(g[0] == r["lang"] for g, r in zip(got, rows, strict=True)) >= 0.9 * len(rows)
    assert judge("日本日本")[3] and not judge("12 34")[3]
    rng = random.Random(1)
    pure = {k: [r["text"] for r in docs.where(f"lang = '{k}' and length(text) between 150 and 250").limit(30).collect()] for k in ("en", "de")}
    mixed = [judge(rng.choice(pure["en"])[:120] + " " + rng.choice(pure["de"])[:120]) for _ in range(40)]
    assert sum(not m[3] for m in mixed) >= 10
