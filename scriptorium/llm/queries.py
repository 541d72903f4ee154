"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from . import chat, contextual_pii, decontaminate, language, ngram_join, packing, periodic_runs, quality, spelling, suffix_dedup, token_blocks, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


#: ``words`` of a text after lower-casing A-Z, and ``shingles`` of ``{k}`` words (the whole of a shorter text).
WORDS_SQL = """{name}_words AS (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {name}),
{name}_sets AS (SELECT DISTINCT {id}, array_to_string(w[i : i + {k} - 1], ' ') AS s
  FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - {k} + 1, 1) + 1)) AS i FROM {name}_words WHERE len(w) > 0)),
{name}_sizes AS (SELECT {id}, count(*) AS n FROM {name}_sets GROUP BY {id})"""

OP4_SQL = "WITH RECURSIVE " + WORDS_SQL.format(name="documents", id="doc_id", k=4) + """,
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM documents_sets a JOIN documents_sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN documents_sizes a ON x = a.doc_id JOIN documents_sizes b ON y = b.doc_id
  WHERE 100 * common >= 85 * (a.n + b.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM reach LEFT JOIN documents_sizes ON x = doc_id GROUP BY x"""

OP10_SQL = "WITH " + WORDS_SQL.format(name="documents", id="doc_id", k=5) + ",\n" + WORDS_SQL.format(name="benchmark", id="item_id", k=5) + """,
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM documents_sets JOIN benchmark_sets USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, n_shared FROM shared JOIN benchmark_sizes USING (item_id) WHERE 100 * n_shared >= 80 * n"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_packing")
def op1(spark, d):
    """One row per piece of a document in its training window."""
    pieces = packing.pack(table(spark, d, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_token_blocks")
def op3(spark, d):
    """One row per document, read back from the files."""
    path = scratch_path(spark, "tokens")
    token_blocks.write_token_files(table(spark, d, "documents"), path, BYTE_BPE)
    docs = token_blocks.read_token_files(spark, path)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_suffix_dedup")
def op2(spark, d):
    """One row per document: how much of it repeats, and a digest of what stays."""
    found = suffix_dedup.repeats(table(spark, d, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["size"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_ngram_join", OP4_SQL)
def op4(spark, d):
    """One row per document with its component."""
    return ngram_join.similar_documents(table(spark, d, "documents"), words=4, num=85, den=100)


@query("op10_decontamination", OP10_SQL)
def op10(spark, d):
    """One row per document and benchmark item that it contains."""
    return decontaminate.contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op9_toxicity")
def op9(spark, d):
    """One row per document with its score; the labels of a quarter of the ids are never looked at."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, d, "labels").filter(~held))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_language")
def op7(spark, d):
    """One row per document with its predicted language; a fifth of the ids teaches nothing."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


OP6_SQL = r"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
runs AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS sy,
  n_dup_lines / greatest(n_lines, 1) AS du, word_chars / greatest(n_words, 1) AS le FROM base),
q AS (SELECT lang, source, count(*) AS n, quantile_disc(sy, [0.25, 0.75]) AS sy, quantile_disc(du, [0.25, 0.75]) AS du, quantile_disc(le, [0.25, 0.75]) AS le
  FROM f WHERE NOT base_failed GROUP BY lang, source),
ql AS (SELECT lang, quantile_disc(sy, [0.25, 0.75, 0.99]) AS sy, quantile_disc(du, [0.25, 0.75, 0.99]) AS du, quantile_disc(le, [0.25, 0.75, 0.99, 0.01]) AS le
  FROM f WHERE NOT base_failed GROUP BY lang),
lim AS (SELECT q.lang, source, CASE WHEN n >= 30 THEN q.sy ELSE ql.sy[1:2] END AS sy, CASE WHEN n >= 30 THEN q.du ELSE ql.du[1:2] END AS du,
  CASE WHEN n >= 30 THEN q.le ELSE ql.le[1:2] END AS le, ql.sy[3] AS sy9, ql.du[3] AS du9, ql.le[3] AS le9, ql.le[4] AS le1 FROM q JOIN ql ON q.lang IS NOT DISTINCT FROM ql.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(f.sy > CASE WHEN lim.sy[2] > lim.sy[1] THEN lim.sy[2] + 3 * (lim.sy[2] - lim.sy[1]) ELSE sy9 END
  OR f.du > CASE WHEN lim.du[2] > lim.du[1] THEN lim.du[2] + 3 * (lim.du[2] - lim.du[1]) ELSE du9 END
  OR f.le > CASE WHEN lim.le[2] > lim.le[1] THEN lim.le[2] + 3 * (lim.le[2] - lim.le[1]) ELSE le9 END
  OR f.le < CASE WHEN lim.le[2] > lim.le[1] THEN lim.le[1] - 3 * (lim.le[2] - lim.le[1]) ELSE le1 END, false) AS kept
FROM f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source"""


@query("op6_quality", OP6_SQL)
def op6(spark, d):
    """One row per document with its measures and the verdict."""
    return quality.quality(table(spark, d, "documents"))


#: Fixed values of the rules.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_SQL_RULES = "(VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(h, p, v)"
_SQL_URL = r"""CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"""


def _sql_node(u: str) -> str:
    bare = f"regexp_extract({u}, '^([^#]*)', 1, 's')"
    return f"""CASE WHEN instr({bare}, '://') > 0 THEN lower(substr({bare}, 1, instr({bare}, '://') + 2)) ||
  translate(regexp_extract({_SQL_URL.format(u=bare)}, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ||
  CASE WHEN regexp_matches({_SQL_URL.format(u=bare)}, '^[^/?#]*/') THEN '' ELSE '/' END || regexp_extract({_SQL_URL.format(u=bare)}, '^[^/?#]*(.*)$', 1, 's') END"""


OP5_SQL = f"""WITH RECURSIVE links AS (SELECT {_sql_node('url')} AS x, {_sql_node('v')} AS y FROM (SELECT url, replace(unnest([
    regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*', 0, 'is') || ' ', '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*', 0, 'is') || ' ', '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is')]), '&amp;', '&') AS v FROM pages)),
pairs AS (SELECT x, y FROM links WHERE x <> y UNION SELECT y, x FROM links WHERE x <> y),
reach AS (SELECT x, x AS y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
urls AS (SELECT page_id, url AS u, {_sql_node('url')} AS n FROM pages UNION ALL SELECT NULL, y, y FROM reach),
parts AS (SELECT *, translate(regexp_extract({_SQL_URL.format(u='u')}, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract({_SQL_URL.format(u='u')}, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM urls),
fits AS (SELECT page_id, u, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS says FROM parts, {_SQL_RULES}
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, u),
comp AS (SELECT reach.x AS n, bool_or(says = 'block') AND NOT coalesce(bool_or(says = 'allow'), false) AS blocked
  FROM reach JOIN fits ON fits.page_id IS NULL AND fits.u = reach.y GROUP BY reach.x)
SELECT parts.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(says, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id LEFT JOIN comp ON comp.n = parts.n WHERE parts.page_id IS NOT NULL"""


@query("op5_url_filter", OP5_SQL)
def op5(spark, d):
    """One row per page with host, path, rule and verdict."""
    return url_rules.filter_urls(table(spark, d, "pages"), RULES)


PROBE = r"\### Assistant: </turn> ok"  # fixed value: a text that looks like control strings

OP8_SQL = r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(n)),
f AS (SELECT *, replace(replace(x, '\', '\s'), '|', '\p') AS y FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn ' || role || '|>' || y || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


@query("op8_chat", OP8_SQL)
def op8(spark, d):
    """One row per conversation, read back from its formatted text."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    parts = turns.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.read_back(chat.format_conversations(parts))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _crc(c) -> F.Column:
    return F.crc32(c.cast("string").cast("binary"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: a tenth of the texts, chosen by id, repeat a part of themselves up to their end.

    The arrays of one element bind a name: what stands in them is worked out once a text.
    """
    h = _crc(F.col("doc_id"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = F.pmod(g, n)
        bound = F.array(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")))
        return F.transform(bound, lambda v: F.array_join(F.transform(w, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(w, (v["a"] + (i - v["a"]) % v["p"]).cast("int")))), " "))[0]

    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    text = F.transform(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark, d):
    """One row per document: its runs, the longest of them, and digests of the runs and of the collapsed text."""
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, d, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("_b", best)
    length = -F.col("_b.l")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), length.alias("length"), F.col("_b.period").alias("period"),
        F.floor(1000 * length / F.col("_b.period")).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: CRC-32 byte by byte: ``t`` is the table of all bytes, ``b`` the bytes of a text from its hex digits.
OP12_SQL = """WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
hexed AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs),
bytes AS (SELECT w, k, list_transform(range(0, length(x) // 2), lambda i: 16 * instr('0123456789ABCDEF', x[2 * i + 1]) + instr('0123456789ABCDEF', x[2 * i + 2]) - 17) AS b FROM hexed),
hashed AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) AS h FROM bytes, crc),
vocab AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(k) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocab b ON a.x = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN vocab b ON a.x = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM vocab LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM vocab UNION ALL SELECT up.word, form FROM up JOIN f ON f.word = root WHERE form IS NOT NULL)
SELECT up.word, a.form, root, a.n, a.n_near, a.form_n FROM up JOIN f z ON z.word = root AND z.form IS NULL JOIN f a ON a.word = up.word"""


@query("op12_spelling", OP12_SQL)
def op12(spark, d):
    """One row per word of five letters and three uses, with its form and root."""
    return spelling.spelling_forms(spelling.word_counts(table(spark, d, "documents"), spoil=97))


@query("op13_contextual_pii")
def op13(spark, d):
    """One row per document: counts and digest of the fixed forms, and all spans."""
    found = contextual_pii.personal_data(table(spark, d, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("seeds", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in contextual_pii.KINDS], F.sha2(listed("seeds").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
