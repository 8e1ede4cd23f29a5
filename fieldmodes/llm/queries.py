"""Queries opN_<name> over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.llm import (align, contamination, divergence, katz, pieces, quality, simhash, substring, tokencounts, toolcalls, topk,
                            urls, warc)
from fieldmodes.llm.tables import documents, keep, prepare
from fieldmodes.session import scratch_path


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the 32k model, and whether they decode to its text."""
    prepare(spark)
    ids = pieces.encode(documents(spark, sf_dir).select("doc_id", "text"))
    return pieces.decode(ids).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                     F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "ids")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after three batches.

    Batch 1 inserts every document with its counts; batch 2 deletes the copies (documents whose text
    a smaller id has); batch 3 revises the rest whose runs of white space can be one space, recounted.
    Every batch is sent twice."""
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    version = F.lit("byte_bpe_50k")
    rollup = tokencounts.Rollup(spark, scratch_path(spark, "token-rollup"))

    def send(batch: int, changes: DataFrame, op: str) -> None:
        changes = changes.withColumn("version", version).withColumn("op", F.lit(op))
        for _ in range(2):
            rollup.apply(batch, changes)

    send(1, tokencounts.count_tokens(docs), "insert")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    first = keep(docs.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "text-copies")
    copies = keep(docs.select("doc_id", "source", "lang", digest.alias("digest")).join(first, "digest").where("doc_id > first").select("doc_id", "source", "lang"), "copies")
    gone = copies.withColumns({"tokens": F.lit(None).cast("long"), "chars": F.lit(None).cast("long")})
    send(2, gone, "delete")
    plain = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    looser = docs.where(plain != F.col("text")).withColumn("text", plain).join(copies.select("doc_id"), "doc_id", "left_anti")
    send(3, tokencounts.count_tokens(looser), "revise")
    return rollup.totals()


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and risk-controlled verdict of every document."""
    prepare(spark)
    return quality.quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through monolithic archives, the normaliser and the offset index, read back."""
    prepare(spark)
    index = warc.normalise(warc.write_archives(documents(spark, sf_dir, "pages")))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff score and unigram base score of every document, a fifth of them held out."""
    prepare(spark)
    return katz.train_and_score(documents(spark, sf_dir).select("doc_id", "text"))[1]


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document (13 words, at most 2 of them substituted)."""
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = contamination.decontaminate(docs, documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("_leaked") > 0).alias("contaminated"), F.size("_leaked").cast("long").alias("n_items"),
                      F.array_join(F.transform("_leaked", lambda i: i.cast("string")), ",").alias("item_ids"))


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chat turn as a linked, ordered, validated tool message in canonical JSON."""
    prepare(spark)
    out = toolcalls.format_tool_chat(toolcalls.tool_turns(documents(spark, sf_dir, "conversations")), toolcalls.SCHEMAS)
    return out.withColumn("errors", F.array_join("errors", ","))


WHITE = r"[\x20\x09-\x0D]+"


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of 20 words seen earlier covers, and the digest of the rest."""
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = substring.substring_dedup(docs, window=20)
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), WHITE), lambda w: w != "")
    return out.select("doc_id", (F.size(kept) + F.col("_n_removed")).cast("long").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                      F.sha2(F.array_join(kept, " "), 256).alias("kept_sha256"))


SITES = [urls.site("block", "net", "/"), urls.site("allow", "example.net", "/en/"),
         urls.site("block", "example.com", "/de/"), urls.site("allow", "org", "/fr/")]
#: The method's own rules: what no site rule decides.
GLOBS = [urls.Rule(action, host, path, f"{host} {path}", 1) for action, host, path in (
    ("block", "*.spam-*", "*"), ("block", "*.cheap-*", "*"), ("block", "*casino*", "*"), ("block", "*.ads.*", "*"), ("block", "*", "*/ads/*"),
    ("block", "*", "*.exe"), ("block", "*", "*.zip"), ("block", "*", "*sessionid=*"), ("allow", "*.docs.*", "/*"), ("block", "*.xn--*", "*"))]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, site rule and verdict of every page's url."""
    prepare(spark)
    out = urls.url_verdicts(documents(spark, sf_dir, "pages").select("page_id", "url"), SITES + GLOBS)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.when(F.col("_tier") == 0, F.col("_rule")).alias("rule"), F.col("_verdict").alias("verdict"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (4-word shingles, 4 bits)."""
    prepare(spark)
    out = simhash.simhash_components(documents(spark, sf_dir), width=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    prepare(spark)
    return divergence.divergence(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of the two vocabularies, of every document."""
    prepare(spark)
    return align.align(documents(spark, sf_dir), digest=True).withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of highest inner product for every hundredth vector, against all rows."""
    prepare(spark)
    return topk.top_k(documents(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")


_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_PLAIN = _WORDS.format("translate(coalesce(text, ''), '" + contamination.UPPER + contamination.DROPPED + "', '" + contamination.LOWER + "')")

#: Alignments of equal words on a diagonal, then the best window of 13: brute force over all pairs.
OP6_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS t, item_id, {_PLAIN} AS ws FROM benchmark),
test AS (SELECT t, item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS j FROM items),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS ws FROM documents),
body AS (SELECT r, len(ws) AS m, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM docs),
pairs AS (SELECT r, t, item_id, n, m, i - j AS diag, j FROM body JOIN test USING (w)),
near AS (SELECT *, count(*) OVER (PARTITION BY r, t, diag ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c,
                count(*) OVER (PARTITION BY r, t, diag) AS total FROM pairs),
hit AS (SELECT DISTINCT r, item_id FROM near
        WHERE CASE WHEN n >= 13 THEN c >= 11 AND least(n, m - diag) - greatest(0, -diag) >= 13 ELSE total = n END)
SELECT doc_id, count(hit.r) > 0 AS contaminated, count(hit.r) AS n_items,
       coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS item_ids
FROM docs LEFT JOIN hit USING (r) GROUP BY r, doc_id
"""

OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def _like(glob: str) -> str:
    return glob.replace("_", "\\_").replace("*", "%")


_SITE_FITS = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')"
_SITE_CASES = [(r.name, r.action, _SITE_FITS.format(r.host[2:], r.path[:-1])) for r in sorted(SITES, key=lambda r: -len(r.name))]
_GLOB_CASES = [(r.action, f"('.' || host) LIKE '{_like(r.host)}' ESCAPE '\\' AND (path || query) LIKE '{_like(r.path)}' ESCAPE '\\'")
               for r in sorted(GLOBS, key=lambda r: (-len(r.name), r.action != "block", r.name))]
OP9_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages),
r AS (SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query FROM r)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {fits} THEN '{name}'" for name, _, fits in _SITE_CASES)} END AS rule,
       CASE {" ".join(f"WHEN {fits} THEN '{action}'" for _, action, fits in _SITE_CASES)}
            {" ".join(f"WHEN {fits} THEN '{action}'" for action, fits in _GLOB_CASES)} ELSE 'allow' END AS verdict
FROM h
"""

OP7_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, len({_WORDS.format("coalesce(text, '')")}) AS words FROM conversations),
m AS (SELECT *, CASE role WHEN 'user' THEN 'call-' || turn WHEN 'assistant' THEN 'call-' || (turn - 1) END AS call_id,
             CASE WHEN role = 'user' THEN CASE WHEN ends_with(coalesce(text, ''), '?') THEN 'search' WHEN words < 40 THEN 'lookup' ELSE 'summarise' END END AS tool,
             CASE WHEN role = 'user' AND (turn // 2) % 4 < 3 THEN 'call-' || (turn + 2)
                  WHEN role = 'user' AND turn >= 8 THEN 'call-' || (turn - 8) END AS need FROM t),
c AS (SELECT DISTINCT conv_id, call_id, turn, need FROM m WHERE role = 'user'),
walk AS (SELECT conv_id, call_id, call_id AS at, 0 AS r FROM c
         UNION ALL SELECT w.conv_id, w.call_id, k.call_id, w.r + CAST(k.turn >= c.turn AS INTEGER)
                   FROM walk w JOIN c ON c.conv_id = w.conv_id AND c.call_id = w.at JOIN c k ON k.conv_id = c.conv_id AND k.call_id = c.need),
rk AS (SELECT conv_id, call_id, CAST(max(r) AS BIGINT) AS rank FROM walk GROUP BY ALL),
n AS (SELECT conv_id, call_id, count(*) FILTER (role = 'user') AS calls, count(*) FILTER (role = 'assistant') AS results,
             min(turn) FILTER (role = 'user') AS first FROM m WHERE call_id IS NOT NULL GROUP BY ALL),
j AS (SELECT m.*, n.calls, n.results, n.first, k.calls AS need_calls, rk.rank FROM m LEFT JOIN n USING (conv_id, call_id) LEFT JOIN rk USING (conv_id, call_id)
      LEFT JOIN n k ON k.conv_id = m.conv_id AND k.call_id = m.need),
e AS (SELECT *, list_sort(list_filter([
        CASE WHEN role = 'user' AND tool = 'search' AND (words < 1 OR words > 100) THEN 'range:limit' END,
        CASE WHEN role = 'user' AND tool = 'lookup' AND words < 1 THEN 'range:words' END,
        CASE WHEN role = 'user' AND tool = 'summarise' AND (words // 4 < 10 OR words // 4 > 1000) THEN 'range:max_words' END,
        CASE WHEN role = 'user' AND text IS NULL THEN 'missing:text' END,
        CASE WHEN role = 'user' AND need IS NOT NULL AND coalesce(need_calls, 0) = 0 THEN 'unresolved:' || need END,
        CASE WHEN role = 'user' AND calls > 1 THEN 'duplicate_id' END,
        CASE WHEN role = 'user' AND results = 0 THEN 'unanswered' END,
        CASE WHEN role = 'assistant' AND calls = 0 THEN 'orphan_result' END], lambda x: x IS NOT NULL)) AS errs FROM j),
a AS (SELECT *, CASE tool WHEN 'search' THEN '{{"limit":' || words || ',"query":' || to_json(text) || '}}'
                          WHEN 'lookup' THEN '{{"text":' || to_json(text) || ',"words":' || words || '}}'
                          WHEN 'summarise' THEN '{{"max_words":' || (words // 4) || ',"text":' || to_json(text) || '}}' END AS args FROM e)
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, call_id,
       CASE WHEN role = 'assistant' THEN first END AS linked_turn, CASE WHEN role = 'user' THEN rank END AS rank,
       CASE WHEN role IN ('user', 'assistant') THEN coalesce(rank, 0) ELSE 0 END AS order_rank,
       array_to_string(errs, ',') AS errors,
       CASE role WHEN 'user' THEN '{{"arguments":' || args || ',"call_id":"' || call_id || '","content":null,"name":"' || tool || '","role":"user"}}'
                 WHEN 'assistant' THEN '{{"call_id":"' || call_id || '","content":' || coalesce(to_json(text), 'null') || ',"role":"tool"}}'
                 ELSE '{{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || '}}' END AS json
FROM a
"""

_SHARE = "(1 + 1000000000 * ({} + 1)::HUGEINT // ({} + v))"
_F = "(({0} - {1}) * ({0} - {1}) // {1})"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{contamination.UPPER}', '{contamination.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
           FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(own.c, 0)::HUGEINT AS c, k.c::HUGEINT AS lc, v, n.n, l.n AS ln
          FROM g JOIN k USING (lang) LEFT JOIN own USING (lang, source, term) JOIN n USING (lang, source) JOIN l USING (lang)),
p AS (SELECT *, {_SHARE.format("c", "n")} AS p, {_SHARE.format("lc", "ln")} AS q FROM full_),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum({_F.format("x.p", "y.p")}), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
         LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, {_F.format("p", "q")}::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_quality_rules, op4_warc, op5_lm_scoring, op6_benchmark_decontamination, op7_tool_call_linking, op8_substring_dedup, op9_url_filter, op10_simhash_near_dedup,
                              op11_source_divergence, op12_token_alignment, op13_exact_top_k)}
ORACLES: dict[str, str] = {"op4_warc": OP4_SQL, "op7_tool_call_linking": OP7_SQL, "op9_url_filter": OP9_SQL, "op6_benchmark_decontamination": OP6_SQL,
                            "op11_source_divergence": OP11_SQL, "op13_exact_top_k": OP13_SQL}
