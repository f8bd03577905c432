"""One query for each text operator, over the whole of its table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, langid, licenses, quality, secrets, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    done = chat.format_chat(turns.unionByName(odd))
    done = done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = tokenizer()
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    back = bpe.decode(ids.withColumn("n_tokens", F.size("token_ids").cast("long")), ranks, keep=("doc_id", "n_tokens"), packed="packed")
    return back.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records of archives of 1,000 pages, against a replica in which every 50th
    record has a byte flipped and every 77th is lost: what the audit locates."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    place = pages.withColumn("archive", F.floor(F.col("page_id") / 1000)).withColumn("offset", F.pmod("page_id", F.lit(1000)) * (1 << 16))
    whole = place.withColumn("content", warc.record(F.col("url"), F.col("page_id"), F.col("html")))
    flipped = F.concat(F.expr("substring(content, 1, length(content) - 5)"), F.encode(F.lit("\u0001"), "UTF-8"), F.expr("right(content, 4)"))
    replica = whole.filter("page_id % 77 != 5").withColumn("content", F.when(F.col("page_id") % 50 == 3, flipped).otherwise(F.col("content")))
    found = warc.audit(*(warc.manifest(x, "archive", "offset", "content") for x in (whole, replica)))
    return found.select((F.col("archive") * 1000 + F.col("offset") / (1 << 16)).cast("long").alias("page_id"), F.col("offset"), "left_length", "left_digest", "right_length", "right_digest", "status")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), modulus=100)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.hits(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_bpe, op3_licenses, op4_warc, op5_ann, op6_secrets, op7_simhash, op8_langid, op9_quality, op10_decontam)}

_ASCII_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _op1_sql() -> str:
    marks = [*chat.FOREIGN, chat.OPEN, chat.BODY, chat.NEXT, chat.CLOSE]
    text = "replace(t, chr(92), chr(92) || chr(92))"
    for m in marks:
        text = f"replace({text}, '{m}', '{m[0]}' || chr(92) || '{m[1:]}')"
    return f"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
esc AS (SELECT *, {text} AS e, lag(r) OVER w AS before FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  (sum(length(e)) + sum(CASE WHEN before IS NULL OR before != r THEN length(r) + {len(chat.OPEN) + len(chat.BODY) + len(chat.CLOSE)} ELSE {len(chat.NEXT)} END))::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id"""


_OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}})) AS s FROM d, sizes),
found AS (SELECT doc_id, s.i AS i, spots.n AS n, item FROM spots JOIN grams ON grams.n = spots.n AND grams.g = s.g),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

_OP4_SQL = """
WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 50 = 3 THEN left(html, length(html) - 1) || chr(1) ELSE html END AS other FROM pages),
r AS (SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:record:' || page_id || '>' || e || 'WARC-Target-URI: ' || regexp_replace(url, '[\\r\\n]', ' ', 'g') || e || 'WARC-Date: 2024-01-01T00:00:00Z' || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e AS head, html || e || e AS a, other || e || e AS b, page_id % 77 = 5 AS lost
  FROM p, (SELECT chr(13) || chr(10) AS e))
SELECT page_id, (page_id % 1000) * 65536 AS "offset", strlen(head || a) AS left_length, sha256(head || a) AS left_digest,
  CASE WHEN NOT lost THEN strlen(head || b) END AS right_length, CASE WHEN NOT lost THEN sha256(head || b) END AS right_digest, CASE WHEN lost THEN 'missing' ELSE 'corrupt' END AS status
FROM r WHERE lost OR a != b"""

def _rows(rows) -> str:
    """Rows of texts and numbers as SQL values."""
    say = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


_OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
t AS (SELECT * FROM (VALUES {_rows((k, *t) for k, t in enumerate(licenses.TEMPLATES))}) v(t, label, phrase, body)),
tw AS (SELECT t, unnest(string_split(body, ' ')) AS word, unnest(range(len(string_split(body, ' ')))) AS pos FROM t),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS spot FROM d),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM dw WHERE word IN (SELECT word FROM tw) GROUP BY word),
rare AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), word) AS r FROM (SELECT DISTINCT t, word FROM tw) LEFT JOIN df USING (word)),
posts AS (SELECT tw.t, tw.word, tw.pos FROM tw JOIN rare ON tw.t = rare.t AND tw.word = rare.word WHERE r <= 6),
sizes AS (SELECT t, count(*) AS size FROM posts GROUP BY t),
best AS (SELECT doc_id, t, max(c) AS c FROM (SELECT doc_id, t, spot - pos AS place, count(*) AS c FROM dw JOIN posts USING (word) GROUP BY ALL) GROUP BY ALL),
ok AS (SELECT best.doc_id, label, c::DOUBLE / size AS share FROM best JOIN sizes USING (t) JOIN t USING (t) JOIN d ON d.doc_id = best.doc_id
  WHERE c::DOUBLE / size >= 0.6 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')),
base AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_rows(licenses.BASE.items())}) v(phrase, label)),
places AS (SELECT dw.doc_id, label, spot FROM dw JOIN base ON dw.word = base.p[1] JOIN d ON d.doc_id = dw.doc_id WHERE d.w[spot + 1:spot + len(p)] = p),
n AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM ok) GROUP BY doc_id),
top AS (SELECT doc_id, max(share) AS share FROM ok GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN top USING (doc_id)"""


def _op6_sql() -> str:
    # the last issued kind is told by what its runs hold, as SQL patterns can not look around
    kinds = [(rank, kind, pattern, least, rank == 0) for rank, (kind, pattern, least) in enumerate(secrets.BASE)]
    kinds += [(len(secrets.BASE) + k, kind, pattern, 0, False) for k, (kind, pattern) in enumerate(secrets.ISSUED[:-1])]
    kinds.append((len(secrets.BASE) + len(secrets.ISSUED) - 1, secrets.ISSUED[-1][0], "[A-Za-z0-9+/_-]+", 0, False))
    say = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rank, kind, pattern, least, grouped in kinds:
        key = f"regexp_extract_all(text, {say(pattern)}, {int(grouped)})"
        test = f"length(k) >= {least}"
        if kind == "mixed":
            test = "length(k) BETWEEN 24 AND 128 AND regexp_matches(k, '[0-9]') AND regexp_matches(k, '[a-z]') AND regexp_matches(k, '[A-Z]')"
        parts.append(f"""SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, before + list_sum(list_transform(gaps[1:i], lambda g: length(g))) AS s, length(m) AS size, k
  FROM (SELECT doc_id, source, gaps, i, found[i] AS m, keys[i] AS k, coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS before
    FROM (SELECT doc_id, source, regexp_split_to_array(text, {say(pattern)}) AS gaps, regexp_extract_all(text, {say(pattern)}) AS found, {key} AS keys, unnest(range(1, len(regexp_extract_all(text, {say(pattern)})) + 1)) AS i
      FROM documents WHERE regexp_matches(text, {say(pattern if kind != 'mixed' else '[A-Za-z0-9+/_-]{24}')}))) WHERE {test}""")
    mark = "kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT"
    base = len(secrets.BASE)
    return f"""
WITH spans AS ({' UNION ALL '.join(parts)}),
held AS (SELECT k, count(DISTINCT source) <= 2 AND count(DISTINCT doc_id) <= 8 AS live FROM spans GROUP BY k),
seen AS (SELECT spans.*, live FROM spans JOIN held USING (k)),
told AS (SELECT doc_id, {', '.join(f"count(*) FILTER (rank = {r}) AS n_{k}" for r, (k, _, _) in enumerate(secrets.BASE))},
  string_agg({mark}, ',' ORDER BY s, rank) FILTER (rank < {base}) AS b, string_agg({mark}, ',' ORDER BY s, rank, s + size, kind) FILTER (rank < {base} OR live) AS a,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM seen GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k, _, _ in secrets.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM documents d LEFT JOIN told USING (doc_id)"""


ORACLES = {"op3_licenses": _OP3_SQL, "op4_warc": _OP4_SQL, "op6_secrets": _op6_sql(), "op1_chat": _op1_sql(), "op10_decontam": _OP10_SQL}
