"""Core operators on small fixtures, against plain Python."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.config import Settings, load_dotenv
from folioflux.errors import AuthError, ConfigError, FolioError, RateLimitError, StoreError, TransientError
from folioflux.functions import html as H
from folioflux.functions import text as T
from folioflux.operators import chunking, context, evaluation, filters, retrieval
from folioflux.plans import catalogue, generation
from folioflux.sources import loaders
from folioflux.sources.store import Store, changes, guarded, near_duplicates


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_identity_and_cleaning(spark):
    assert one(spark, "é\r\nx\ry", T.normalize_text) == "é\nx\ny"
    assert one(spark, "a  \n\n\n\nb \t\n", T.clean_text) == "a\n\nb"
    assert one(spark, "é", T.content_hash) == one(spark, "é", T.content_hash)
    assert [one(spark, "x" * n, T.heuristic_tokens) for n in (0, 1, 4, 5)] == [0, 1, 1, 2]
    assert one(spark, "Café_1, 日本!", T.words) == ["café_1", "日本"]
    assert one(spark, "The cat, a hat.", T.normalize_answer) == ["cat", "hat"]
    assert one(spark, "api_key=abc, Bearer xyz", T.redact) == "[REDACTED], [REDACTED]"
    assert one(spark, "  2.5 ", T.retry_after) == 2.5 and one(spark, "-1", T.retry_after) is None
    assert one(spark, "requests per day", T.daily_quota) and not one(spark, "check quota", T.daily_quota)


@pytest.mark.parametrize(("path", "pattern", "fits"), [("a/b.md", "**/*.md", True), ("b.md", "**/*.md", True), ("a/b.md", "*.md", False), ("a/b/c.txt", "a/**", True), ("a+b", "a+b", True), ("ab", "a?", True), ("a/", "a?", False)])
def test_glob(path, pattern, fits):
    assert bool(re.search(T.glob_regex(pattern).replace(r"\z", r"\Z"), path)) is fits


def test_html():
    text, title = H.parse_html("<title>A  b</title><style>p{}</style><p>one <b>two</b><br>three<script>x</script><ul><li>x</li></ul>&amp;")
    assert title == "A b" and text == "one two\nthree\n\nx&"


def test_html_cut_references():
    page = "<title>a &amp;&amp</title><h1>b &quot &amp;&amp c &amp;lt; &copy; &#39;&middot</h1>"
    assert H.parse_html(page) == ("b \" && c &lt; © '·", "a &&")
    assert H.parse_html(page, H.PLAIN) == ("b &quot && c &lt; © &#39;&middot", "a &&amp")


def test_html_extract_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    titles = ["a &amp;&amp", "b &quot", "c &am", "d &quot;x&quot; &amp;amp", "e &", "f"]
    pages = [(i, f"http://x/{i}", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>{t} x &copy; y</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"select page_id, text_md5, title from ({catalogue.ORACLE['html_extract']})").fetchall()}
    assert {r["page_id"]: (r["text_md5"], r["title"]) for r in catalogue.html_extract(spark, str(tmp_path)).collect()} == want


def test_chunk_invariants(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é.\n😀 ") for _ in range(rng.randint(0, 400))) for _ in range(25)] + ["# A\nx\n## B\ny\n# C\n" + "w " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for make in (chunking.fixed_chunks, chunking.recursive_chunks, chunking.markdown_chunks):
        rows = make(docs, 12, 5).collect()
        for i, t in enumerate(texts):
            own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["ordinal"])
            assert [r["ordinal"] for r in own] == list(range(len(own))) and bool(own) == bool(t)
            at = 0
            for r in own:
                assert r["text"] == t[r["start_char"] : r["end_char"]] and r["start_char"] <= at <= r["end_char"] and r["token_count"] <= 12
                at = r["end_char"]
            assert at == len(t)
    paths = {r["heading_path"] for r in chunking.markdown_chunks(docs, 12, 5).where("doc_id = 25").collect()}
    assert paths == {"A", "A > B", "C"}
    for bad in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ConfigError):
            chunking.check_budget(*bad)


def test_boilerplate(spark):
    page = "Top\nbody {}\nFoot"
    texts = ["\f".join(page.format(i) for i in range(3)), "Top\nx\fTop\ny", None, "", "a\r\n  note \x0bb\n\n", "\f".join(f" T \n\nr{i}\x85T\n\nq\n" for i in range(4))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in chunking.strip_boilerplate(frame, ("note",)).collect()}
    assert got == {0: "body 0\fbody 1\fbody 2", 1: "Top\nx\fTop\ny", 2: None, 3: "", 4: "a\nb", 5: "r0\fr1\fr2\fr3"}


def test_boilerplate_strip_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["a\nb\nc", "", "a\n", "\n\na", "a\n \nb", "a\r\nb\r\nc\r\n", "x\ty\t\n\t\nx\ty", "a\x85b\x0bc\n\u2028", None, "Head\nFoot\nq\nFoot", "\u3000a\xa0\na\na \na", "p\x0cq\n\x0c", "  k  \n k\nk\nr"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.execute(f"select doc_id, text_md5 from ({catalogue.ORACLE['boilerplate_strip']})").fetchall())
    assert {r["doc_id"]: r["text_md5"] for r in catalogue.boilerplate_strip(spark, str(tmp_path)).collect()} == want


META = [({"lang": "en", "year": 2020, "a.b": "x"}, {"lang": "fr"}), ({"lang": "en", "year": None}, {"year": 1.5}), ({"draft": True}, {}), ({}, {"lang": None, "n": "5"})]


@pytest.mark.parametrize(
    ("found", "want"),
    [
        ({}, {0, 1, 2, 3}), ({"lang": "fr"}, {0}), ({"lang": {"$ne": "fr"}}, {1}), ({"year": {"$gte": 1.5}}, {0, 1}), ({"year": {"$ne": "x"}}, {0, 1}), ({"draft": 1}, {2}), ({"draft": {"$gt": 0}}, {2}),
        ({"n": {"$gt": 4}}, set()), ({"a.b": {"$prefix": "x"}}, {0}), ({"lang": {"$exists": False}}, {2, 3}), ({"year": {"$nin": [2020]}}, {1}), ({"year": {"$in": []}}, set()), ({"$not": {"lang": "en"}}, {0, 2, 3}),
        ({"$or": [{"lang": "fr"}, {"draft": True}]}, {0, 2}), ({"ordinal": {"$lt": 2}, "doc_id": {"$prefix": "d"}}, {0, 1}),
    ],
)
def test_filters(spark, found, want):
    import json

    docs = spark.createDataFrame([(f"d{i}", f"u{i}", json.dumps(d)) for i, (d, _) in enumerate(META)], "doc_id string, source_uri string, m string").withColumn("metadata", F.parse_json("m"))
    chunks = spark.createDataFrame([(str(i), f"d{i}", i, json.dumps(c)) for i, (_, c) in enumerate(META)], "chunk_id string, doc_id string, ordinal int, m string").withColumn("metadata", F.parse_json("m"))
    assert {int(r[0]) for r in filters.filter_chunk_ids(chunks, docs, found).collect()} == want


@pytest.mark.parametrize("bad", [{"$x": 1}, {"a": {}}, {"a": None}, {"a": {"$gt": True}}, {"a": float("nan")}, {"$and": []}, {"$not": 3}, {"a": {"$in": "x"}}, {"ordinal": "x"}, {"doc_id": 3}, {"a": {"$exists": 1}}, {"a": {"$prefix": 2}}, {"a": {"$near": 1}}, {'a"b': 1}, {1: 2}, []])
def test_filter_mistakes(spark, bad):
    with pytest.raises(ConfigError):
        filters._mapping(bad)


def test_dense_equals_full_sort(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[7] = v[8]
    frame = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(v)], "chunk_id long, vector array<float>").repartition(5)
    q = frame.where("chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    ids = frame.where("chunk_id % 3 > 0").select("chunk_id")
    for f in (retrieval.dense, retrieval.dense_sql):
        for allowed in (None, ids):
            got = f(q, frame, 7, allowed).collect()
            for i in range(6):
                s = np.round(v.astype(float) @ v[i].astype(float), 9)
                order = [j for j in np.lexsort((np.arange(300), -s)) if allowed is None or j % 3][:7]
                assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == order
    with pytest.raises(ConfigError):
        retrieval.check_k(0)


def test_bm25_by_hand(spark):
    texts = {"a": "red fish blue fish", "b": "one fish", "c": "red red", "d": ""}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    q = spark.createDataFrame([(1, "Red fish red?"), (2, "!!"), (3, "none")], "query_id int, text string")
    got = {r["chunk_id"]: r["score"] for r in retrieval.bm25(q, chunks, 10).collect()}
    average = 8 / 4

    def score(words):
        s = 0.0
        for term, df in (("red", 2), ("fish", 2)):
            tf = words.count(term)
            s += math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
        return s

    assert got == {k: pytest.approx(score(t.split()), abs=1e-8) for k, t in texts.items() if t}


def test_bm25_indexed_equals_bm25(spark, monkeypatch):
    """Whatever the blocks, buckets and packs, and without rows for pairs of query and chunk."""
    rng = random.Random(4)
    words = ["the", "red", "fish", "é_1", "日本", "a", "b", "c"]
    texts = [(f"c{i}", " ".join(rng.choice(words[: 3 + i % 6]) for _ in range(rng.randint(0, 30)))) for i in range(150)] + [("x", ""), ("y", "!!")]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.sample(words, 3)) + "?") for i in range(12)] + [(12, ""), (13, "none"), (14, None)], "query_id int, text string")
    index = retrieval.postings(chunks)
    assert "Exchange hashpartitioning" not in index._jdf.queryExecution().executedPlan().toString()
    want = {c: dict(zip(*np.unique(T.plain_words(t), return_counts=True), strict=True)) for c, t in texts}
    got = {c: {} for c, _ in texts}
    for r in index.collect():
        assert r["length"] == sum(want[r["chunk_id"]].values()) and (r["term"] is None) == (r["tf"] == 0)
        got[r["chunk_id"]] |= {r["term"]: r["tf"]} if r["tf"] else {}
    assert got == want
    some = chunks.where("chunk_id like 'c1%'").select("chunk_id")
    rows = lambda f: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 8)) for r in f.collect())
    for ids, idf, scope in ((None, "plus", "candidates"), (some, "robertson", "corpus"), (some, "plus", "candidates")):
        assert rows(retrieval.bm25_indexed(queries, index, 7, ids, idf, scope)) == rows(retrieval.bm25(queries, chunks, 7, ids, idf, scope))
    whole = rows(retrieval.bm25(queries, chunks, 7))
    for name, value in (("BROADCAST_NUMBERS", 40), ("BUCKET_CHUNKS", 5), ("PACKED", 7)):
        monkeypatch.setattr(retrieval, name, value)
        assert rows(retrieval.bm25_indexed(queries, index.orderBy("term"), 7)) == whole
    twice = spark.createDataFrame([("a", "red red fish"), ("a", "red red fish"), ("b", "fish the")], "chunk_id string, text string")
    merged = retrieval.postings(twice).groupBy("chunk_id", "length", "term").agg(F.sum("tf").cast("int").alias("tf"))
    assert rows(retrieval.bm25_indexed(queries, retrieval.postings(twice), 7)) == rows(retrieval.bm25_indexed(queries, merged, 7)) != []


def test_fusion_mmr_rerank(spark):
    rank = lambda rows: spark.createDataFrame([(1, k + 1, c, s, "x") for k, (c, s) in enumerate(rows)], "query_id int, rank int, chunk_id string, score double, source string")
    a, b = rank([("x", 3.0), ("y", 2.0)]), rank([("y", 9.0), ("z", 1.0)])
    assert [(r["chunk_id"], r["score"]) for r in retrieval.rrf([a, b], 3).orderBy("rank").collect()] == [("y", pytest.approx(1 / 61 + 1 / 62, abs=1e-9)), ("x", pytest.approx(1 / 61, abs=1e-9)), ("z", pytest.approx(1 / 62, abs=1e-9))]
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.99, 0.14]), ("r", [0.0, 1.0])], "chunk_id string, vector array<double>")
    pool = rank([("p", 0.9), ("q", 0.85), ("r", 0.5)])
    order = lambda lam: [r["chunk_id"] for r in retrieval.mmr(pool, v, 3, lam).orderBy("rank").collect()]
    assert order(1.0) == ["p", "q", "r"] and order(0.3) == ["p", "r", "q"]
    scores = spark.createDataFrame([(1, "p", 1.0), (1, "q", 2.0), (1, "r", 1.0)], "query_id int, chunk_id string, score double")
    assert [r["chunk_id"] for r in retrieval.rerank(pool, scores, 3).orderBy("rank").collect()] == ["q", "p", "r"]
    with pytest.raises(Exception, match="no chunk for hit"):
        retrieval.hydrate(pool, v.where("chunk_id <> 'q'")).collect()


def test_context_and_citations(spark):
    hits = spark.createDataFrame([(1, 1, "a", "x" * 20), (1, 2, "b", " " + "x" * 20), (1, 3, "c", "  "), (1, 4, "d", "y" * 20), (1, 5, "e", "z" * 80)], "query_id int, rank int, chunk_id string, text string")
    rows = context.context_blocks(hits, 14).orderBy("label").collect()
    assert [(r["label"], r["chunk_id"], r["joined_tokens"], r["truncated"]) for r in rows] == [(1, "a", 6, True), (2, "d", 13, True)]
    q = spark.createDataFrame([(1, "Why?"), (2, "How?")], "query_id int, text string")
    made = {r["query_id"]: r for r in context.prompts(q, context.context_texts(context.context_blocks(hits, 14))).collect()}
    assert made[1]["nonce"] not in made[2]["user"] and made[2]["n_blocks"] == 0 and made[1]["user"].endswith("Question: Why?")
    answered = {r["query_id"]: r["answer"] for r in generation.answer(context.prompts(q, context.context_texts(context.context_blocks(hits, 14))), generation.ExtractiveGenerator).collect()}
    assert answered[1].endswith("[1]") and answered[2] == context.ABSTENTION
    with pytest.raises(Exception, match="blank"):
        context.prompts(spark.createDataFrame([(1, " \n")], "query_id int, text string"), context.context_texts(context.context_blocks(hits, 14))).collect()


def test_metrics_by_hand(spark):
    gold = spark.createDataFrame([(1, i, "d", 10 * i, 10 * i + 5) for i in range(3)], "query_id int, gold_idx int, doc_id string, start_char int, end_char int")
    hits = spark.createDataFrame([(1, 1, "e", 0, 5), (1, 2, "d", 0, 4), (1, 3, "d", 0, 23), (1, 4, "d", 40, 50), (1, 5, "d", 12, 14)], "query_id int, rank int, doc_id string, start_char int, end_char int")
    r = evaluation.item_metrics(hits, gold, (1, 3, 5)).first()
    assert (r["recall_1"], r["recall_3"], r["mrr"], r["hit_1"], r["precision_5"]) == (0, 1, 0.5, 0, 0.6)
    dcg, ideal = 1 / math.log2(3) + 1 / 2, 1 + 1 / math.log2(3) + 1 / 2
    assert r["ndcg_5"] == pytest.approx(dcg / ideal)
    docs = spark.createDataFrame([("u", "d", "say\nhello  world (ok)")], "source_uri string, doc_id string, text string")
    spans = evaluation.resolve_spans(spark.createDataFrame([(1, 0, "u", "hello world (ok)")], "query_id int, gold_idx int, source_uri string, quote string"), docs).first()
    assert (spans["start_char"], spans["end_char"]) == (4, 21)


def documents(spark, rows):
    return spark.createDataFrame(rows, "source_uri string, text string").select(T.stable_doc_id(F.col("source_uri")).alias("doc_id"), "source_uri", "text", F.parse_json(F.lit('{"doc.dedup_group": "g"}')).alias("metadata"))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = documents(spark, [("a", "alpha beta gamma. " * 60), ("b", "delta"), ("c", "words of c")])
    assert store.ingest(first)["documents"] == 3
    before = store.tables()["chunks"].count()
    assert store.ingest(first)["documents"] == 0 and store.tables()["chunks"].count() == before
    again = documents(spark, [("b", "delta two"), ("d", "words of c")])
    store.ingest(again)
    tables = store.tables()
    assert tables["documents"].count() == 4 and tables["chunks"].count() == tables["embeddings"].count()
    assert tables["chunks"].where("try_variant_get(metadata, '$[\"doc.duplicate_of\"]', 'string') is not null").count() >= 1
    disk = documents(spark, [("a", "alpha beta gamma. " * 60), ("e", "new")])
    assert store.sync(disk)["deleted"] == 3
    with pytest.raises(StoreError):
        store.sync(disk, apply=True)
    report = store.sync(disk, apply=True, max_delete=1.0)
    assert report["added"] == 1 and {r["source_uri"] for r in store.tables()["documents"].collect()} == {"a", "e"}
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "s"), model="other").ingest(documents(spark, [("x", "y")]))
    store.compact()
    assert store.tables()["documents"].count() == 2


def test_store_parts(spark, tmp_path):
    root = str(tmp_path / "s")
    store = Store(spark, root)
    assert store.manifest() is None and store.count() == 0
    store.ingest(documents(spark, [("a", "red fish"), ("b", "blue fish"), ("c", "")]))
    begun = store.manifest()
    store.ingest(documents(spark, [("b", "green bird")]))
    with pytest.raises(StoreError):  # another writer was first
        store._publish(begun, {}, spark.createDataFrame([("document", "x")], "name string, key string"))
    tables = store.tables()
    assert {r["text"] for r in tables["documents"].collect()} == {"red fish", "green bird", ""}
    assert {r["term"] for r in tables["postings"].where("term is not null").collect()} == {"red", "fish", "green", "bird"}
    assert [r["ordinal"] for r in store.document_chunks(T_id("a")).collect()] == [0] and store.document(T_id("b")).first()["text"] == "green bird"
    order = [r["doc_id"] for r in store.documents_in_order().collect()]
    assert order == sorted(order) and store.chunks_in_order().count() == 2 == store.embeddings_in_order().count()
    one = store.embeddings_in_order().first()["chunk_id"]
    ids = spark.createDataFrame([(one,)], "chunk_id string")
    store.upsert_embeddings(spark.createDataFrame([(one, [1.0] * 64)], "chunk_id string, vector array<double>"), 64)
    assert store.vectors(ids).first()["vector"] == [1.0] * 64 and store.count() == 2
    hit = store.search(spark.createDataFrame([(1, [1.0] * 64)], "query_id int, vector array<double>"), 1).first()
    assert (hit["chunk_id"], hit["score"]) == (one, 64.0)
    for bad in ([(one, [1.0])], [(one, [1.0] * 64)] * 2, [(one, None)]):
        with pytest.raises(Exception, match="dimension"):
            store.upsert_embeddings(spark.createDataFrame(bad, "chunk_id string, vector array<double>"), 64)
    snap = str(tmp_path / "snap")
    made = store.save_snapshot(snap)
    assert made["rows"] == 2 and store.load_snapshot(snap).count() == 2
    store.delete_embeddings(ids)
    assert store.count() == 1
    with pytest.raises(StoreError):
        store.load_snapshot(snap)
    store.compact()
    assert store.count() == 1 and len(store.manifest()["parts"]) == 1 and store.tables()["documents"].count() == 3
    store.save_snapshot(snap)
    spark.createDataFrame([("x", [1.0] * 64)], "chunk_id string, vector array<float>").write.mode("append").parquet(store.save_snapshot(snap)["folder"])
    with pytest.raises(StoreError):
        store.load_snapshot(snap)
    assert store.delete(spark.createDataFrame([(T_id("a"),)], "doc_id string")) == 1 and store.tables()["postings"].where("term = 'red'").count() == 0


def T_id(uri):
    import hashlib

    return hashlib.sha256(uri.encode()).hexdigest()[:32]


def test_diff_and_duplicates(spark):
    old = spark.createDataFrame([("a", "1", "h"), ("b", "2", "h")], "source_uri string, doc_id string, content_hash string")
    new = spark.createDataFrame([("a", "1", "h"), ("c", "3", "h")], "source_uri string, doc_id string, content_hash string")
    assert {r["source_uri"]: r["status"] for r in changes(new, old).collect()} == {"a": "unchanged", "b": "deleted", "c": "added"}
    assert guarded(changes(new, old), old, 0.5).first()["over_delete_guard"] is False
    v = spark.createDataFrame([("a", 1, "g", [1.0, 0.0]), ("b", 2, "g", [1.0, 0.0]), ("c", 3, "g", [1.0, 0.0]), ("d", 4, "h", [1.0, 0.0])], "chunk_id string, doc_id int, grp string, vector array<double>")
    assert {r["chunk_id"]: r["winner_id"] for r in near_duplicates(v).collect()} == {"b": "a", "c": "a"}


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """As all pairs, one by one: groups in blocks, copies, ties, other dimensions, nulls, and numbers that are none."""
    rng = random.Random(5)
    rows = []
    for i in range(260):
        v = [rng.choice([-0.5, 0.1, 0.3, 0.7]) for _ in range(3 if i % 17 else 4)]
        v = None if i % 71 == 3 else [None, *v[1:]] if i % 71 == 4 else [float("nan"), *v[1:]] if i % 71 == 5 else v
        rows.append((f"c{rng.randint(0, 10**6)}", rng.choice([None, *range(60)]), rng.choice(["g"] * 8 + ["h", "i", None]), v, i % 3 > 0))
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id int, grp string, vector array<double>, asked boolean")

    def pairs(asked):
        best = {}
        for c, d, g, v, a in rows:
            for w, e, h, u, _ in rows:
                if None in (d, e, g, v, u) or g != h or not e < d or len(u) != len(v) or None in u + v or (asked and not a):
                    continue
                s = 0.0
                for x, y in zip(u, v, strict=True):
                    s += x * y
                if s >= 0.6 or math.isnan(s):
                    best[c] = min(best.get(c, (2, 0.0, "")), (1, 0.0, w) if math.isnan(s) else (0, -s, w))
        return {c: (w, None if k else -s) for c, (k, s, w) in best.items()}

    for block in (1_000_000, 100):
        monkeypatch.setattr("folioflux.sources.store.BLOCK_NUMBERS", block)
        for asked in (None, F.col("asked")):
            got = {r["chunk_id"]: (r["winner_id"], None if math.isnan(r["score"]) else r["score"]) for r in near_duplicates(frame, 0.6, asked).collect()}
            assert got == pairs(asked is not None) and len(got) > 50
    assert "Join" not in near_duplicates(frame.where("grp = 'h'"), 0.6)._jdf.queryExecution().executedPlan().toString()


def test_loaders(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "sub" / "skipme").mkdir(parents=True)
    (root / "a.txt").write_bytes("﻿é".encode())
    (root / "sub" / "b.md").write_bytes(b"caf\xe9")
    (root / "c.html").write_text("<title>T</title><p>x</p>")
    (root / "d.bin").write_bytes(b"1")
    (root / "n.txt").write_bytes(b"a\0b")
    (root / "sub" / "skipme" / "e.txt").write_text("no")
    got = {r["source_uri"]: (r["status"], r["text"], r["title"]) for r in loaders.load_directory(spark, str(root), ignore=["skipme"]).collect()}
    assert got == {"a.txt": ("loaded", "é", None), "sub/b.md": ("loaded", "café", None), "c.html": ("loaded", "x", "T"), "d.bin": ("skipped", None, None), "n.txt": ("failed", None, None)}
    assert unicodedata.normalize("NFC", got["a.txt"][1]) == "é"


def test_allowance():
    clock = [0.0]
    limits = generation.Allowance(rpm=2, tpm=100, clock=lambda: clock[0])
    assert [limits.book(10), limits.book(10)] == [0, 0] and limits.book(10) == pytest.approx(30)
    clock[0] = 30.0
    assert limits.book(10) == 0
    with pytest.raises(ConfigError):
        limits.book(101)
    clock[0] = 1000.0
    limits.close(5)
    assert limits.book(100) == pytest.approx(5)
    clock[0] = 1005.0
    assert limits.book(100) == 0 and limits.book(50) == pytest.approx(30)
    with pytest.raises(ConfigError):
        generation.Allowance(rpm=0)


class Service:
    context_window, max_output_tokens = 100, 10

    def __init__(self, script):
        self.script, self.calls = script, []

    def generate(self, system, user):
        self.calls.append(user)
        step = self.script.get(user, [])
        if step and (e := step.pop(0)):
            raise e
        return generation.Generation(user.upper(), generation.Usage("s", "m"))


def test_batches_of_requests():
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    how = {"clock": lambda: clock[0], "sleep": sleep, "rng": random.Random(1)}
    service = Service({"a": [RateLimitError("slow", retry_after=3.0), TransientError("x")], "b": [AuthError("no")], "d": [TransientError("x")] * 9})
    got = generation.asked(service, [("", x) for x in "abcd"], generation.Retries(2, 0.5, 1.0), **how)
    assert [got[0].text, got[2].text] == ["A", "C"] and isinstance(got[1], AuthError) and isinstance(got[3], TransientError)
    assert service.calls[:4] == list("abcd") and service.calls.count("d") == 3 and service.calls.count("b") == 1 and clock[0] >= 3.0
    limited = generation.asked(Service({}), [("", "x")] * 3, allowance=generation.Allowance(rpm=2, clock=lambda: clock[0]), **how)
    assert [g.text for g in limited] == ["X"] * 3 and sum(slept) >= 30
    assert all(0 <= p <= c for p, c in zip(generation.Retries(4, 0.5, 1.5).pauses(random.Random(2)), (0.5, 1.0, 1.5, 1.5), strict=True))
    for bad in ((-1, 1, 1), (1, 0, 1)):
        with pytest.raises(ConfigError):
            generation.Retries(*bad)


def test_chain():
    none = generation.Retries(0)
    chain = generation.Chain(Service({"a": [TransientError("x")], "b": [AuthError("no")], "c": [TransientError("x")]}), Service({"c": [RateLimitError("y")]}))
    got = chain.asked([("", x) for x in "abcd"], retries=none)
    assert [g.text for g in (got[0], got[3])] == ["A", "D"] and isinstance(got[1], AuthError) and isinstance(got[2], RateLimitError)
    assert chain.generators[1].calls == ["a", "c"] and chain.context_window == 100
    with pytest.raises(AuthError):
        generation.Chain(generation.ScriptedGenerator([AuthError("no")]), generation.ScriptedGenerator(["b"])).generate("", "")
    assert generation.Chain(generation.ScriptedGenerator([TransientError("a")]), generation.ScriptedGenerator(["b"])).generate("", "").text == "b"
    with pytest.raises(ConfigError):
        generation.Chain()
    assert "redacted" in str(FolioError("x", api_key="k1")) and "k1" not in str(FolioError("x", api_key="k1"))


def test_settings(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.folioflux]\nchunk_tokens = 99\n[tool.folioflux.profiles.big]\nchunk_tokens = 512\n')
    load = lambda **k: Settings.load(tmp_path, **k).chunk_tokens
    assert load(environ={}) == 99 and load(profile="big", environ={}) == 512 and load(environ={"FOLIOFLUX_CHUNK_TOKENS": "70"}) == 70 and load(environ={}, chunk_tokens=80) == 80
    with pytest.raises(ConfigError):
        Settings.load(tmp_path, environ={}, chunk_tokens="x")
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='2'\n")
    env = {"A": "0"}
    assert load_dotenv(tmp_path / ".env", env) == 1 and env == {"A": "0", "B": "2"}


def test_stream(spark, tmp_path):
    from folioflux.streaming.ingest import ingest_stream

    spark.createDataFrame([("u", "hello"), ("v", "there")], "source_uri string, text string").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "c")).awaitTermination()
    assert store.tables()["documents"].count() == 2


def test_cached_vectors(spark):
    from folioflux.sources.store import cached_vectors

    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    cache = texts.where("id = 2").select(F.lit("m").alias("model_id"), T.fingerprint(F.col("text")).alias("text_hash"), F.array(F.lit(9.0)).alias("vector"))
    got, fresh = cached_vectors(texts, cache, "m", lambda c: F.array(F.length(c).cast("double")))
    assert {r["id"]: r["vector"] for r in got.collect()} == {1: [1.0], 2: [9.0], 3: [1.0]} and fresh.count() == 1


def test_observability():
    import logging

    from folioflux.observability import JsonFormatter, Timer, emit

    now = iter([0.0, 1.0, 2.0, 2.5])
    timer = Timer(lambda: next(now))
    for _ in range(2):
        with timer.part("x"):
            pass
    assert timer.parts == {"x": 1500.0}
    seen = []
    emit(seen.append, "done", n=3)
    emit(lambda e: 1 / 0, "done")
    assert seen[0].values == {"n": 3}
    assert "hunter2" not in JsonFormatter().format(logging.LogRecord("a", 20, "f", 1, "password=hunter2", (), None))


def test_bpe_counter():
    import os

    from folioflux.functions.tokens import bpe_counter

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    count = bpe_counter(path)
    assert count("") == 0 and 0 < count("hello world") < 5
    text = "some words to pack " * 30
    spans = chunking.packed(text, chunking.atoms(text, 0, len(text), 12, count), 12, 4, count)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(count(text[a:b]) <= 12 for a, b in spans)


def words_of(rows):
    return [r["chunk_id"] for r in rows.orderBy("rank").collect()]


def test_rag(spark, tmp_path):
    from folioflux.operators import transforms
    from folioflux.plans import rag

    told = []
    docs = documents(spark, [("a", "Red fish swim in the sea. They eat plankton."), ("b", "Blue birds fly over hills."), ("c", "Green trees stand still in the wood.")])
    whole = rag.build(spark, str(tmp_path / "s"), docs, k=2, hook=told.append)
    q = spark.createDataFrame([(1, "red fish"), (2, "birds hills")], "query_id int, text string")
    for mode in ("dense", "bm25", "hybrid"):
        whole.mode = mode
        top = {r["query_id"]: r["text"] for r in whole.retrieve(q).where("rank = 1").collect()}
        assert top[1].startswith("Red") and top[2].startswith("Blue"), mode
    got = whole.query(q)
    answers = {r["query_id"]: r["answer"] for r in got["answers"].collect()}
    assert answers == {1: "Red fish swim in the sea. [1]", 2: "Blue birds fly over hills. [1]"}
    assert {(r["query_id"], r["source_uri"]) for r in got["citations"].collect()} == {(1, "a"), (2, "b")}
    whole.min_score = 99.0
    assert {r["answer"] for r in whole.query(q)["answers"].collect()} == {context.ABSTENTION}
    whole.min_score = None
    assert {r["doc_id"] for r in whole.retrieve(q, {"source_uri": {"$prefix": "c"}}).collect()} <= {T_id("c")}

    def broken(queries, ranking, chunks):
        return ranking.select("query_id", "chunk_id", F.raise_error(F.lit("down")).cast("double").alias("score"))

    plain = words_of(whole.retrieve(q.where("query_id = 1")))
    whole.rerank = broken
    assert words_of(whole.retrieve(q.where("query_id = 1"))) == plain and told[-1].name == "rerank_failed"
    whole.rerank = rag.lexical
    assert whole.retrieve(q).where("rank = 1 and source = 'rerank'").count() == 2
    whole.rerank, whole.diversity, whole.window, whole.transform = None, 0.5, 1, transforms.sentences
    assert whole.retrieve(q).count() == 4
    whole.transform = transforms.generated(lambda: generation.ScriptedGenerator(["- fish\n\n2. the sea\nx\ny"]), 2)
    assert [r["text"] for r in whole.transform(q.where("query_id = 1")).orderBy("position").collect()] == ["fish", "the sea"]
    with pytest.raises(Exception, match="no phrasings"):
        transforms.generated(lambda: generation.ScriptedGenerator([TransientError("down")]))(q).collect()
    assert transforms.identity(q).count() == 0
    swept = rag.sweep(lambda **s: rag.Rag(whole.store, **s), [{"mode": "dense"}, {"mode": "bm25"}], lambda r: r.retrieve(q).agg(F.lit("n").alias("metric"), F.count("*").cast("double").alias("value")))
    assert {r["setting"] for r in swept.collect()} == {"mode=dense", "mode=bm25"}
    assert '"answer"' in rag.as_json(got["answers"]).first()["json"]
    with pytest.raises(ConfigError):
        rag.Rag(whole.store, mode="x")
    assert whole.delete_document(T_id("a")) == 1
    whole.compact()
    assert whole.store.tables()["documents"].count() == 2
    lists = rag.embedded_in_batches(lambda texts: [[float(len(t))] for t in texts], 2)
    assert [r["vector"] for r in rag.embedded(q, "query_id", lists, 1).orderBy("query_id").collect()] == [[8.0], [11.0]]
    with pytest.raises(Exception, match="another size"):
        rag.embedded(q, "query_id", lists, 2).collect()


def test_answer_evaluation(spark):
    items = spark.createDataFrame([(1, "the cat"), (2, "a dog"), (3, None), (4, "x")], "query_id int, reference string")
    answers = spark.createDataFrame([(1, "cat [1]", None), (2, context.ABSTENTION, None), (3, context.ABSTENTION, None), (4, None, "TransientError")], "query_id int, answer string, error_kind string")
    gold = spark.createDataFrame([(1, 0, "d", 0, 5), (2, 0, "d", 0, 5), (4, 0, "d", 0, 5)], "query_id int, gold_idx int, doc_id string, start_char int, end_char int")
    cited = spark.createDataFrame([(1, 1, "d", 3, 9), (1, 2, "e", 0, 5)], "query_id int, label int, doc_id string, start_char int, end_char int")
    reports = spark.createDataFrame([(1, 0.5), (2, 1.0)], "query_id int, validity_rate double")
    got = {r["metric"]: r["value"] for r in evaluation.evaluate_answers(items, answers, reports, cited, gold).collect()}
    assert got == {"n_items": 4, "n_errors": 1, "error_rate": 0.25, "citation_validity": 0.5, "citation_precision": 0.5, "cited_rate": 1.0, "token_f1": pytest.approx((2 / 3 + 0) / 2), "false_abstain_rate": 0.5, "abstain_rate": 1.0}
    run = lambda kinds: [tuple(r) for r in evaluation.stopped_at(spark.createDataFrame(list(enumerate(kinds)), "position int, error_kind string"), 3).collect()]
    bad = "TransientError"
    assert run([None, bad, bad, None, bad, bad, bad, bad]) == [(6, "failures")] and run([bad, None, "QuotaExhausted", bad, bad, bad]) == [(2, "refused")] and run([bad, bad, None]) == []
    times = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    assert tuple(evaluation.latencies(times).first()) == (50.5, pytest.approx(95.05), 100.0, 100)
    assert evaluation.render_report([{"metric": "mrr", "value": 0.5}]) == "mrr  0.500"
    gone = spark.createDataFrame([("x", "u")], "doc_id string, source_uri string")
    said = spark.createDataFrame([(1, "yes [1]")], "query_id int, answer string")
    blocks = spark.createDataFrame([(1, 1, "k")], "query_id int, label int, chunk_id string")
    places = spark.createDataFrame([(1, "k", "d", 0, 4)], "query_id int, chunk_id string, doc_id string, start_char int, end_char int")
    with pytest.raises(Exception, match="no document for citation"):
        context.cited_sources(said, blocks, places, gone).collect()


def test_command_line(spark, tmp_path, capsys):
    import json

    from folioflux import cli

    root = tmp_path / "corpus"
    root.mkdir()
    (root / "a.txt").write_text("Red fish swim in the sea.")
    (root / "b.md").write_text("Blue birds fly over hills.")
    call = lambda *a: (cli.main(["--store", str(tmp_path / "s"), "--json", *a], spark), capsys.readouterr())
    assert call("query", "red fish")[0] == 5
    code, out = call("ingest", str(root))
    assert code == 0 and json.loads(out.out)["documents"] == 2
    code, out = call("query", "red fish", "--mode", "bm25", "-k", "1")
    assert code == 0 and json.loads(out.out) == {"answer": "Red fish swim in the sea. [1]", "citations": [{"label": 1, "source_uri": "a.txt", "start_char": 0, "end_char": 25}]}
    assert len(json.loads(call("inspect")[1].out)["documents"]) == 2
    (tmp_path / "items.jsonl").write_text('{"id": "1", "question": "red fish?", "gold": [{"source_uri": "a.txt", "quote": "fish  swim"}]}\n\n{"id": "2", "question": "what?"}\n')
    (tmp_path / "t.json").write_text('{"mrr": {"baseline": 0.9, "tolerance": 0.1}}')
    code, out = call("eval", str(tmp_path / "items.jsonl"), "--thresholds", str(tmp_path / "t.json"))
    assert code == 0 and json.loads(out.out)["metrics"]["mrr"] == 1.0
    (tmp_path / "t.json").write_text('{"mrr": {"baseline": 1.9, "tolerance": 0.1}}')
    assert call("eval", str(tmp_path / "items.jsonl"), "--thresholds", str(tmp_path / "t.json"))[0] == 6
    (root / "b.md").unlink()
    assert json.loads(call("sync", str(root), "--apply")[1].out)["deleted"] == 1
    assert call("query", "red fish", "-k", "0")[0] == 3
    from folioflux.errors import EvaluationError

    for bad in ("x", '{"id": "1", "question": "q", "more": 1}', '{"id": "1"}', '{"id": "1", "question": "q", "gold": [{}]}', ""):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(EvaluationError):
            loaders.load_items(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "t.json").write_text('{"mrr": {"baseline": 1}}')
    with pytest.raises(EvaluationError):
        loaders.load_thresholds(spark, str(tmp_path / "t.json"))
    assert [r["source_uri"] for r in loaders.load_corpus(spark, str(root)).collect()] == ["a.txt"]
