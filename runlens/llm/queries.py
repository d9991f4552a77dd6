"""One registered query per operator, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import common as C
from . import chat, decontam, html, learning, license, lm, mixing, neardup, omh, prefix_trie, quality, spelling, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


#: The two word rules in DuckDB.
SQL_LETTERS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_VISIBLE = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: A one-row table crc(t) with the remainders of all bytes, and the checksum of a list of bytes by it.
SQL_CRC_TABLE = """(SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
SQL_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], {0}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
#: The UTF-8 bytes of a text of code points below U+0800.
SQL_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))"


@query("op1_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_LETTERS.format("text")} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {SQL_LETTERS.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS words
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT rid, item, s, dw.n FROM dw JOIN iw USING (words)),
p AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS place FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain ten-word windows of benchmark items, and how many of their words are inside one."""
    return decontam.contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("spans")


@query("op9_near_duplicates", f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_VISIBLE.format("text")} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85 over five-word shingles."""
    found = neardup.near_duplicates(C.table(spark, sf_dir, "documents"), similarity=0.85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op3_chat_format", """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM c),
k AS (SELECT *, len(regexp_extract_all(t, '[\\[<]\\\\*(?:/?(?:INST|ROLE)\\]|/?s>)')) AS marks FROM t),
f AS (SELECT *, length(t) + marks + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(url_encode(r)) END AS n FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, rendered and read back."""
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"  # control strings as contents
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), "formatted").select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )


@query("op5_license_scan", f"""
WITH t(id, label, base, size, place, a, b) AS (VALUES {", ".join(str(x).replace("True", "true").replace("False", "false") for x in license.pairs())}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_LETTERS.format("text")} AS w FROM documents),
g AS (SELECT rid, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT rid, id, label, base, size, base OR size < {license.FULL} AS exact, ceil(size * {license.DRIFT}::DOUBLE) AS width, place, pos FROM g JOIN t USING (a, b)),
m AS (SELECT *, unnest(CASE WHEN exact THEN [pos - place] ELSE [CAST(floor((pos - place) / width) AS BIGINT) - 1, CAST(floor((pos - place) / width) AS BIGINT)] END) AS band FROM h),
k AS (SELECT rid, id, label, base, size, exact, band, min(pos) AS first, count(DISTINCT place) AS places, list([place]::BIGINT[] ORDER BY pos, place DESC) AS chain FROM m GROUP BY ALL),
l AS (SELECT *, CASE WHEN exact OR places < size * {license.SHARE}::DOUBLE THEN places
             ELSE len(list_reduce(chain, lambda e, p: list_concat(list_filter(e, lambda x: x < p[1]), p, list_filter(e, lambda x: x >= p[1])[2:]))) END / size AS share FROM k),
s AS (SELECT *, exact OR (share > coalesce(CASE WHEN lag(band) OVER o = band - 1 THEN lag(share) OVER o END, 0) AND share >= coalesce(CASE WHEN lead(band) OVER o = band + 1 THEN lead(share) OVER o END, 0)) AS best
      FROM l WINDOW o AS (PARTITION BY rid, id ORDER BY band)),
v AS (SELECT *, base AND share = 1 AS here FROM s WHERE best AND share >= CASE WHEN exact THEN 1 ELSE {license.SHARE}::DOUBLE END),
r AS (SELECT rid, count(*) FILTER (here) AS n_base, min(first) FILTER (here) AS first_word, max(first) FILTER (here) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (here) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM v GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN r USING (rid)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and sentences of all documents."""
    return license.licenses(C.table(spark, sf_dir, "documents"))


@query("op6_mixing", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, count(*) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
f AS (SELECT *, (sum(size) OVER () * 1.5::DOUBLE - coalesce(sum(size) OVER fill, 0) * 2) / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0)) AS level
      FROM s WINDOW fill AS (ORDER BY size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, size AS source_size, least(CAST(size * 2 AS DOUBLE), max(level) OVER () * weight) AS target, CAST(greatest(1, ceil(size / 1048576), ceil(n / 16384)) AS BIGINT) AS shards FROM f),
m AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS blocks, sum(target) AS total FROM t),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, source NULLS LAST) AS r
      FROM (SELECT source, target, unnest(range(1, CAST(ceil(target * blocks / greatest(total, 1)) AS BIGINT) + 30)) AS j FROM t, m)),
w AS (SELECT source, count(*) AS seats FROM q, m WHERE r <= blocks GROUP BY source),
p AS (SELECT d.*, source_size, target, coalesce(seats, 0) AS seats, CAST('0x' || substr(m, 1, 8) AS BIGINT) % shards AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN w ON d.source IS NOT DISTINCT FROM w.source),
u AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, any_value(seats) AS seats, CAST(greatest(1, ceil(sum(size) / 16)) AS BIGINT) AS n FROM p GROUP BY source, shard),
uq AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY words / (2 * j - 1) DESC, shard) AS r, seats
       FROM (SELECT source, shard, words, seats, unnest(range(1, CAST(ceil(words * seats / greatest(sum(words) OVER (PARTITION BY source), 1)) AS BIGINT) + 30)) AS j FROM u)),
uw AS (SELECT source, shard, count(*) FILTER (r <= seats) AS won FROM uq GROUP BY source, shard),
x AS (SELECT p.*, u.n, least(won, 2 * u.n) AS won, CAST('0x' || substr(md5('mix|' || coalesce(p.source, '') || '|' || p.shard), 1, 8) AS BIGINT) % u.n AS start,
             CAST(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY m, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
      FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source AND p.shard = u.shard JOIN uw ON p.source IS NOT DISTINCT FROM uw.source AND p.shard = uw.shard),
y AS (SELECT *, list_transform([e, e - size], lambda v: (won // n) * v + (((v // 16) * (won % n) + start) // n) * 16
               + (v % 16) * ((((v // 16) + 1) * (won % n) + start) // n - ((v // 16) * (won % n) + start) // n)) AS upto FROM x)
SELECT doc_id, source, size, source_size, target, CAST(shard AS BIGINT) AS shard, CAST(upto[1] - upto[2] AS BIGINT) AS taken FROM y""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix by weight takes of every document."""
    return mixing.mix(C.table(spark, sf_dir, "documents"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is good, learned from the labels that are not held out."""
    docs = C.table(spark, sf_dir, "documents")
    field = quality.train(docs, C.table(spark, sf_dir, "labels"), modulus=3)
    scored = quality.quality(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", learning.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each toxicity category and of being toxic, learned from the labels that are not held out."""
    docs = C.table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, C.table(spark, sf_dir, "labels"), modulus=3)
    scored = toxicity.toxicity(docs.select("doc_id", "text"), chain)
    return scored.select(
        "doc_id", learning.held_out(F.col("doc_id")).alias("held_out"), *[F.col(f"toxicity.{c}").alias(c) for c, _ in toxicity.CATEGORIES],
        F.col("toxicity.toxic").alias("score"), (F.col("toxicity.toxic") >= 0.5).cast("int").alias("predicted"), (F.col("toxicity.toxic") >= 0.5).alias("toxic"),
    )


@query("op8_order_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit with the next one."""
    return omh.with_next(C.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the corpus model over the subword lattice."""
    return lm.scores(C.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(C.table(spark, sf_dir, "pages")).drop("declared")


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counted = token_counts.token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op12_prefix_trie", f"""
WITH crc AS {SQL_CRC_TABLE},
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, {SQL_CRC.format(SQL_BYTES.format("CAST(c AS VARCHAR)"))} % 4 AS h, c - c % 20 AS base FROM (SELECT DISTINCT c FROM o), crc),
b AS (SELECT h.c, o.i, role, text FROM h JOIN o ON o.c = base AND i <= h UNION ALL SELECT o.c, i, role, text FROM o JOIN h ON o.c = h.c AND i > h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, role, text FROM b),
p AS (SELECT c, d, md5(string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY c ORDER BY d)) AS k, text FROM r
      UNION ALL SELECT c, 0, '', NULL FROM h),
n AS (SELECT d, k, min(c) AS m, count(*) AS n, len(regexp_extract_all(coalesce(any_value(text), ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM p GROUP BY d, k),
q AS (SELECT p.c, p.d, n.m, n.k FROM p JOIN n USING (d, k)),
u AS (SELECT n.*, q.m AS pm FROM n LEFT JOIN q ON q.c = n.m AND q.d = n.d - 1),
f AS (SELECT pm AS m, d - 1 AS d, count(*) AS kids FROM u WHERE pm IS NOT NULL GROUP BY ALL),
s AS (SELECT q.d, q.k, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.w) AS saved FROM u LEFT JOIN f USING (m, d) JOIN q ON q.c = u.m AND q.d <= u.d GROUP BY q.d, q.k),
e AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) USING (c, d) GROUP BY d, k)
SELECT u.m AS conv_id, CAST(d AS BIGINT) AS depth, pm AS parent_conv_id, n AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM u JOIN s USING (d, k) LEFT JOIN f USING (m, d) LEFT JOIN e USING (d, k)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations that open like the first of their block."""
    turns = prefix_trie.ordered_turns(C.table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.shared_openings(turns))


@query("op11_spelling", f"""
WITH RECURSIVE crc AS {SQL_CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, c, {SQL_CRC.format(SQL_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM r, crc),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
v AS (SELECT word, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
s AS (SELECT v.word AS a, w.word AS b FROM v JOIN w ON v.less = w.word),
p AS (SELECT a.word AS a, b.word AS b FROM v a JOIN v b USING (i, less) WHERE a.word <> b.word UNION SELECT a, b FROM s UNION SELECT b, a FROM s),
f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, struct_pack(o := -w.n, b := encode(b))) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = b GROUP BY a),
g AS (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
c(word, tip) AS (SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.tip WHERE g.form IS NOT NULL)
SELECT g.word, form, tip AS root, n, n_near, form_n FROM g JOIN c USING (word) WHERE tip IN (SELECT word FROM g WHERE form IS NULL)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with the more frequent words that they are variants of."""
    words = spelling.typed_words(C.table(spark, sf_dir, "documents"))
    return spelling.spelling_groups(words.where((F.char_length("word") >= 6) & (F.col("n") >= 5)))
