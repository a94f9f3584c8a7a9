"""Registered queries of this folder: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, compression_quality, decontaminate, hilbert_shards, lexical_search, licenses, near_dup, quality_rules, spelling,
               substring_dup, token_store, toxicity, url_cascade)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


@query("op5_byte_bpe")
def op5(spark: SparkSession, root: str) -> DataFrame:
    """Every document encoded, and decoded again from the ids."""
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.encode(table(spark, root, "documents").select("doc_id", "text"), codec)
    digests = byte_bpe.decode(coded, codec).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
    return digests


@query("op9_quality_rules")
def op9(spark: SparkSession, root: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    found = quality_rules.judge(table(spark, root, "documents"), table(spark, root, "labels"))
    return found.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "anomaly")


_SHINGLES = """
  words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)"""


@query("op8_minhash_near_dup", f"""
WITH RECURSIVE {_SHINGLES},
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
  reach AS (SELECT doc_id AS node, doc_id AS far FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.far),
  lowest AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN lowest ON node = d.doc_id
""")
def op8(spark: SparkSession, root: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dup.near_duplicates(table(spark, root, "documents"))


@query("op7_substring_dedup", """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words)),
  least AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY h),
  gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM windows JOIN least USING (h) WHERE lo < doc_id),
  lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
""")
def op7(spark: SparkSession, root: str) -> DataFrame:
    """Repeated 50-word passages cut from all documents."""
    cut = substring_dup.cut_repeats(table(spark, root, "documents").select("doc_id", "text"), layout="words")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_template_decontamination")
def op4(spark: SparkSession, root: str) -> DataFrame:
    """Documents that leak a benchmark item, verbatim or with other values: one row per document and item."""
    return decontaminate.leaks(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op10_compression_quality")
def op10(spark: SparkSession, root: str) -> DataFrame:
    """Quality score of every document; learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, root, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = compression_quality.score(docs, compression_quality.fit(docs, table(spark, root, "labels"), ~held))
    return scored.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _in_sql(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


_NORMAL = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]+'), lambda w: w <> '')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


@query("op1_license_scan", f"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_in_sql(n)}, {_in_sql(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))}) v(template, license, text)),
  grams AS (SELECT template, license, len(b) AS size, unnest(b) AS bigram FROM (SELECT template, license, {_PAIRS} AS b FROM (SELECT *, {_NORMAL.format("text")} AS w FROM templates))),
  lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
  units AS (SELECT doc_id, unnest(range(len(u))) AS u, unnest(u) AS t FROM (SELECT doc_id, CASE WHEN len(l) > 1 THEN list_append(l, text) ELSE l END AS u FROM lines)),
  unit_grams AS (SELECT doc_id, u, len(b) AS n, unnest(b) AS bigram FROM (SELECT doc_id, u, {_PAIRS} AS b FROM (SELECT *, {_NORMAL.format("t")} AS w FROM units))),
  met AS (SELECT doc_id, u, n, template, license, size, count(*) AS shared FROM unit_grams JOIN grams USING (bigram) GROUP BY ALL),
  hit AS (SELECT doc_id, u, license, max(2 * shared / (n + size)) AS d FROM met WHERE 200 * shared >= {licenses.PERCENT} * (n + size) GROUP BY ALL)
SELECT doc_id, license, count(*) AS n_units, round(max(d), 6) AS best_dice FROM hit GROUP BY ALL
""")
def op1(spark: SparkSession, root: str) -> DataFrame:
    """Licences named or printed in each document."""
    return licenses.scan(table(spark, root, "documents"))


#: Dimensions of the document shards, and bits of each.
SHARD_DIMENSIONS, SHARD_BITS = ["lang", "source", "n_chars"], 5
_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, in DuckDB."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::UBIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {data}), lambda c, b: xor(c >> 8, crc_t[xor(c & 255::UBIGINT, b)::BIGINT + 1])), "
            "4294967295::UBIGINT)::BIGINT")


def _curve_sql() -> str:
    """Levels of the curve as nested selects: state and index, one bit of every dimension after the other."""
    n, out = len(SHARD_DIMENSIONS), "SELECT *, 0 AS state, 0::BIGINT AS curve FROM coded"
    for bit in reversed(range(SHARD_BITS)):
        cell = " + ".join(f"(((code_{d} >> {bit}) & 1) << {n - 1 - k})" for k, d in enumerate(SHARD_DIMENSIONS))
        out = f"SELECT * REPLACE (f // {1 << n} AS state, curve * {1 << n} + f % {1 << n} AS curve) FROM (SELECT * EXCLUDE (f), steps_t[state * {1 << n} + {cell} + 1] AS f FROM (SELECT *, 0 AS f FROM ({out})))"
        out = f"SELECT * EXCLUDE (f) FROM ({out})"
    return out


@query("op2_hilbert_shards", f"""
WITH crc AS (SELECT {[c for c in _CRC]}::UBIGINT[] AS crc_t), steps AS (SELECT {hilbert_shards.curve_table(3)}::BIGINT[] AS steps_t),
  coded AS (SELECT doc_id, text, crc_t, steps_t, coalesce({_crc_sql("lang")} % 32, 0) AS code_lang, coalesce({_crc_sql("source")} % 32, 0) AS code_source,
              CASE WHEN n_chars > 0 THEN least(length(bin(n_chars)), 31) ELSE 0 END::BIGINT AS code_n_chars FROM documents, crc, steps),
  ranked AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS total FROM ({_curve_sql()}))
SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 16)::BIGINT AS size, coalesce({_crc_sql("text")}, 0) AS text_crc32, 'rows' AS law,
  (r * 40 // total)::INT AS shard, (r - ((r * 40 // total) * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard, curve, code_lang, code_source, code_n_chars
FROM ranked
""")
def op2(spark: SparkSession, root: str) -> DataFrame:
    """All documents in 40 shards along a Hilbert curve over language, source and length."""
    return hilbert_shards.assign(table(spark, root, "documents"), 40, SHARD_DIMENSIONS, bits=SHARD_BITS)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: First labels of the domains on the block list.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


@query("op6_url_cascade", f"""
WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
  rules AS (SELECT *, split_part(key, '/', 1) AS domain, substr(key, strpos(key, '/')) AS prefix
            FROM (VALUES {", ".join(f"({_in_sql(k)}, {_in_sql(a)})" for k, a in RULES)}) v(key, action)),
  fits AS (SELECT page_id, arg_max(key, (length(key), key)) AS rule, arg_max(action, (length(key), key)) AS action FROM parts JOIN rules
           ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN len(list_intersect(string_split(host, '.'), {BLOCKED_NAMES})) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
""")
def op6(spark: SparkSession, root: str) -> DataFrame:
    """Verdict on every page's url: the four rules, then the block list of all domains of the corpus that begin with a blocked name."""
    pages = table(spark, root, "pages")
    rules = spark.createDataFrame(RULES, "key string, action string")
    domains = url_cascade.with_host_path(pages).select(F.explode(url_cascade.page_keys([0])).alias("key")).distinct()
    listed = domains.filter(F.substring_index("key", ".", 1).isin(BLOCKED_NAMES))
    return url_cascade.judge(pages, rules, listed)


@query("op3_token_store")
def op3(spark: SparkSession, root: str) -> DataFrame:
    """All documents written as token shards, and read back by key through the index."""
    docs = table(spark, root, "documents")
    store = token_store.write(docs, token_store.LibraryCodec(public_tokenizers.path("byte_bpe_50k.json")))
    back = token_store.read(store, spark, docs.select("doc_id"))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").cast("bigint").alias("ids_crc32"))


_RUN_CRC = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(k))), lambda i: "
            "('0x' || substr(hex(encode(k)), (2 * i + 1)::BIGINT, 2))::UBIGINT)), lambda c, b: xor(c >> 8, crc_t[xor(c & 255::UBIGINT, b)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT")


@query("op11_spelling_variants", f"""
WITH RECURSIVE crc AS (SELECT {[c for c in _CRC]}::UBIGINT[] AS crc_t),
  runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
  low AS (SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS times FROM runs GROUP BY ALL),
  hashed AS (SELECT r, times, {_RUN_CRC} AS h FROM (SELECT *, id || ':' || r AS k FROM low WHERE length(r) >= 6), crc),
  results AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, times FROM hashed),
  words AS (SELECT word, sum(times)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
  spots AS (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words),
  holes AS (SELECT word, p, left(word, p - 1) AS before, substr(word, p + 1) AS behind FROM spots),
  less AS (SELECT word AS long, before || behind AS short FROM holes),
  pairs AS (SELECT x.word AS a, y.word AS b FROM holes x JOIN holes y ON x.p = y.p AND x.before = y.before AND x.behind = y.behind AND x.word <> y.word
            UNION SELECT long, word FROM less JOIN words ON word = short UNION SELECT word, long FROM less JOIN words ON word = short),
  met AS (SELECT a, b, y.n AS near_n, row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN words y ON y.word = b),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN b END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
            FROM words w LEFT JOIN met ON met.a = w.word AND r = 1),
  chain AS (SELECT word, word AS root, 0 AS step FROM words UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, (SELECT arg_max(root, step) FROM chain WHERE chain.word = forms.word) AS root, n, n_near, form_n FROM forms
""")
def op11(spark: SparkSession, root: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.spelling_variants(table(spark, root, "documents"))


_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op12_lexical_search", f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
  found AS (SELECT row, doc_id, w, len(w) AS n FROM docs WHERE len(w) > 0),
  total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM found),
  asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
  held AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM found) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
  weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM held, total GROUP BY term, n_docs),
  parts AS (SELECT row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM held JOIN weighed USING (term), total),
  scored AS (SELECT item_id, row, doc_id, sum(part)::BIGINT AS score FROM parts JOIN asked USING (term) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op12(spark: SparkSession, root: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op13_toxicity")
def op13(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity score of every document; learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, root, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, root, "labels"), ~held))
    return scored.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
