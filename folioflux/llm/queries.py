"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.llm import chat, decontamination, embedding_lsh, language, licenses, mixture, ngram_join, secrets, toxicity, urls
from folioflux.llm.common import fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mixture.plan(docs)
    first = F.when(F.size("passes") > 0, F.col("passes")[0]["position"])
    found = found.select("doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("position"))
    return found.orderBy("position", "doc_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op7_urls"] = r"""
WITH h AS (SELECT page_id, lower(coalesce(url, '')) AS low,
  CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
r(says, name, rhost, rpath) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
f AS (SELECT *, (SELECT arg_max({'name': name, 'says': says}, length(name)) FROM r
  WHERE (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM p)
SELECT page_id, host, path, best.name AS rule, CASE WHEN best IS NOT NULL THEN best.says
  WHEN host <> '' AND (regexp_matches(low, '://([^/?#]*[.-])?(casino|adserver|porn)[.-]')
    OR regexp_matches(low, '://([^/?#]*[.-])?(cheap-pills|spam-farm|ads-track)[.]')
    OR regexp_matches(low, '[/._-](viagra|malware)[/._-]')) THEN 'block' ELSE 'allow' END AS verdict
FROM f"""

def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    named = F.transform("places", lambda p: p["label"])
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(named).alias("base_labels"),
        listed(F.concat(named, F.col("found"))).alias("labels"),
        F.greatest(F.col("most"), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.rendered("strong"), 256).alias("base_sha256"),
        secrets.rendered(F.array_sort(F.concat("strong", "linked"))).alias("spans"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


ORACLE["op4_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM o UNION SELECT y, x FROM o),
r(node, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.node WHERE r.c < e.y)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.sh)"""

def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.classes(table(spark, sf_dir, "embeddings"))


ORACLE["op9_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.node WHERE r.c < p.y),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM (SELECT node AS vec_id, min(c) AS c FROM r GROUP BY node) LEFT JOIN n ON x = vec_id"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    shares = [F.round(c, 6).alias(c) for c in ("overlap", "question_overlap", "answer_overlap")]
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start_word", *shares)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    model = chat.fit(turns.where(fold("conv_id", 4) != 2))
    found = chat.decoded(turns.drop("role"), model)
    return found.select("conv_id", "turn", "role", (fold("conv_id", 4) == 2).alias("held_out"), F.sha2("rendered", 256).alias("rendered_sha256"))


QUERIES |= {"op1_decontamination": op1_decontamination, "op3_chat": op3_chat}
QUERIES |= {"op9_embeddings": op9_embeddings}
QUERIES |= {"op4_ngram_join": op4_ngram_join}
QUERIES |= {"op5_licenses": op5_licenses, "op10_secrets": op10_secrets}
QUERIES |= {"op2_toxicity": op2_toxicity, "op7_urls": op7_urls}
QUERIES |= {"op6_mixture": op6_mixture, "op8_language": op8_language}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENSE_WORDS = "list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_TEMPLATES = ", ".join(f"('{label}', {sorted(set(t.split()))}, {naming.split()}::VARCHAR[], {licenses.need(len(set(t.split())))}, {licenses.width(t)})" for label, t, naming in licenses.TEMPLATES)
ORACLE["op5_licenses"] = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_LICENSE_WORDS.format("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT rid, doc_id, len(words) AS n_words, list_filter(range(0, len(words) - 1), lambda i: words[i + 1] = 'mit' AND words[i + 2] = 'license') AS mit,
  list_filter(range(0, len(words) - 1), lambda i: words[i + 1] = 'apache' AND words[i + 2] = 'license') AS apache,
  list_filter(range(0, len(words) - 2), lambda i: words[i + 1] = 'general' AND words[i + 2] = 'public' AND words[i + 3] = 'license') AS gpl FROM w),
t(label, tokens, naming, need, width) AS (VALUES {_TEMPLATES}),
c AS (SELECT rid, words, t.* FROM w, t WHERE len(list_intersect(tokens, list_distinct(words))) >= need AND list_has_all(words, naming)),
b AS (SELECT rid, label, tokens, naming, need, words[s + 1:s + width] AS block FROM (SELECT *, unnest(range(0, 1 + greatest(0, len(words) - width))) AS s FROM c)),
m AS (SELECT rid, list(DISTINCT label) AS found, max(len(list_intersect(tokens, list_distinct(block)))::DOUBLE / len(tokens)) AS most FROM b
  WHERE len(list_intersect(tokens, list_distinct(block))) >= need AND list_has_all(block, naming) GROUP BY rid),
l AS (SELECT p.*, list_concat(list_concat(mit, apache), gpl) AS starts, list_concat(list_concat(CASE WHEN len(mit) > 0 THEN ['mit'] ELSE []::VARCHAR[] END, CASE WHEN len(apache) > 0 THEN ['apache'] ELSE []::VARCHAR[] END), CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE []::VARCHAR[] END) AS named,
  coalesce(found, []::VARCHAR[]) AS found, coalesce(most, 0) AS most FROM p LEFT JOIN m USING (rid))
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word, array_to_string(list_sort(named), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(named, found))), ',') AS labels, greatest(most, CASE WHEN len(starts) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM l"""

ORACLE["op6_mixture"] = r"""
WITH s AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 3.0::DOUBLE * source_size AS cap FROM a),
v AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(rank - 1) % 3 + 1] AS weight FROM w),
f AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS step,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM v WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, rank, coalesce(least(cap, (SELECT arg_min(level, step) FROM f WHERE level <= ratio) * weight), cap) AS target FROM f),
d AS (SELECT s.doc_id, s.size, source_size, rank, target, floor(target + 0.5)::BIGINT AS goal,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN rank % 2 = 1 THEN 0.5::DOUBLE ELSE -0.5 END AS a, CASE WHEN goal > 0 THEN least(1.0::DOUBLE, begun::DOUBLE / goal) ELSE 1.0 END AS share,
  (greatest(0, least(size, goal - begun)) + greatest(0, least(size, goal - begun - source_size)) + greatest(0, least(size, goal - begun - 2 * source_size)))::BIGINT AS taken FROM d)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(((1 + a) - sqrt(greatest(0, (1 + a) * (1 + a) - 4 * a * share))) / (2 * a), 9) END AS position FROM e"""


def _spans_sql(name: str, pattern: str, rank: int, kind: str, keep: str = "true") -> str:
    """A CTE {name}(rid, start, fin, rank, kind, m) of a pattern's matches, positions summed over what a split leaves."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT rid, start::BIGINT AS start, (start + length(m))::BIGINT AS fin, {rank} AS rank, '{kind}' AS kind, m FROM (
  SELECT rid, m, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS start FROM (
  SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (
  SELECT rid, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d))) WHERE {keep})"""


_ASSIGN = secrets.ASSIGN.replace("'", "''")
_RUN = r"[A-Za-z0-9+/_=-]+(?:[.][A-Za-z0-9+/_=-]+)*"
_MIXED = "len(list_filter(string_split(m, '.'), lambda x: length(x) >= 20 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))) > 0"
_NAMED = secrets.NAMED.replace("'", "''")
_SHOWN = "string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank)"
ORACLE["op10_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql("assign", secrets.ASSIGN, 0, "assign", f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 6")},
{_spans_sql("access", secrets.ACCESS, 1, "access")}, {_spans_sql("hex", secrets.HEX, 2, "hex")},
{_spans_sql("identifier", secrets.IDENTIFIER, 5, "identifier")}, {_spans_sql("endpoint", secrets.ENDPOINT, 6, "endpoint")},
strong AS (FROM assign UNION ALL FROM access UNION ALL FROM hex), parts AS (FROM access UNION ALL FROM identifier UNION ALL FROM endpoint),
{_spans_sql("runs", _RUN, 3, "weak", _MIXED)},
weak AS (SELECT runs.*, regexp_matches(substr(t, before + 1, start - before), '{_NAMED}') OR regexp_matches(m, '{secrets.ASSIGNED}') AS named
  FROM (SELECT *, coalesce(lag(fin) OVER (PARTITION BY rid ORDER BY start), 0) AS before FROM runs WHERE rid IN (SELECT rid FROM parts)) runs JOIN d USING (rid)),
linked AS (SELECT DISTINCT w.rid, w.start, w.fin, 3 AS rank, 'weak' AS kind, w.m FROM weak w JOIN parts p ON p.rid = w.rid AND p.start < w.fin + {secrets.RADIUS} AND w.start - {secrets.RADIUS} < p.fin AND (p.rank <> 6 OR w.named)
  WHERE NOT EXISTS (FROM (FROM strong UNION ALL FROM parts) s WHERE s.rid = w.rid AND s.start < w.fin AND w.start < s.fin)),
b AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_SHOWN} AS shown FROM strong GROUP BY rid),
a AS (SELECT rid, {_SHOWN} AS spans FROM (FROM strong UNION ALL FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(shown, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""

_ITEM_WORDS = "regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_GRAMS = "CASE WHEN len({0}) = 0 THEN []::VARCHAR[] WHEN len({0}) < 5 THEN [array_to_string({0}, ' ')] ELSE list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' '))) END"
_SHARE = "CASE WHEN len({0}) = 0 THEN 1.0::DOUBLE WHEN len({1}) < 5 THEN contains(' ' || array_to_string(words, ' ') || ' ', ' ' || {0}[1] || ' ')::INT::DOUBLE ELSE len(list_intersect({0}, grams))::DOUBLE / len({0}) END"
ORACLE["op1_decontamination"] = f"""
WITH i0 AS (SELECT row_number() OVER () AS iid, item_id, text, {_ITEM_WORDS.format("coalesce(text, '')")} AS w, regexp_extract(text, '(?s)^(.*)[?]', 1) AS head, regexp_extract(text, '(?s)^.*[?](.*)$', 1) AS tail FROM benchmark),
i1 AS (SELECT *, len(w) AS n, greatest(16, pow(2, ceil(log2(len(w))))::BIGINT) AS l, {_ITEM_WORDS.format("head")} AS hw, {_ITEM_WORDS.format("tail")} AS tw FROM i0 WHERE len(w) > 0),
i2 AS (SELECT iid, item_id, w, n, l, CASE WHEN len(hw) > 0 AND len(tw) > 0 THEN hw ELSE w[1:(n + 1) // 2] END AS q, CASE WHEN len(hw) > 0 AND len(tw) > 0 THEN tw ELSE w[(n + 1) // 2 + 1:] END AS a FROM i1),
i3 AS (SELECT *, {_GRAMS.format("w")} AS sw, {_GRAMS.format("q")} AS sq, {_GRAMS.format("a")} AS sa FROM i2),
tf AS (SELECT iid, term, n, count(*) AS tf FROM (SELECT iid, n, unnest(w) AS term FROM i2) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS items, avg(n) AS average FROM i2),
wt AS (SELECT iid, term, x / sum(x) OVER (PARTITION BY iid) AS x FROM (SELECT iid, term, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average)) AS x FROM tf JOIN df USING (term), st)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS.format("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT rid, l, p, words[p * l + 1:p * l + 2 * l] AS words FROM (SELECT rid, words, l, unnest(range(0, (len(words) - 1) // l + 1)) AS p FROM d, (SELECT DISTINCT l FROM i2) WHERE len(words) > 0)),
t AS (SELECT DISTINCT rid, l, p, unnest(words) AS term FROM p),
s AS (SELECT rid, l, p, iid, round(sum(x), 9) AS score FROM t JOIN wt USING (term) JOIN i2 USING (iid, l) GROUP BY rid, l, p, iid HAVING sum(x) >= {decontamination.THRESHOLD}),
g AS (SELECT s.*, p.words, {_GRAMS.format("p.words")} AS grams, i3.item_id, sw, sq, sa, w, q, a FROM s JOIN p USING (rid, l, p) JOIN i3 USING (iid)),
v AS (SELECT rid, item_id, iid, score, l * p AS start_word, {_SHARE.format("sw", "w")} AS overlap, {_SHARE.format("sq", "q")} AS question_overlap, {_SHARE.format("sa", "a")} AS answer_overlap FROM g)
SELECT doc_id, item_id, round(score, 6) AS score, start_word::BIGINT AS start_word, round(overlap, 6) AS overlap, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap
FROM (SELECT *, row_number() OVER (PARTITION BY rid, iid ORDER BY score DESC, start_word) AS first FROM v WHERE overlap >= {decontamination.CONTAINMENT} AND question_overlap >= {decontamination.PART} AND answer_overlap >= {decontamination.PART}) JOIN d USING (rid) WHERE first = 1"""
