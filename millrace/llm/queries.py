"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, exact_dedup, html_text, jaccard_join, lexical, line_dedup, packing, piece_bpe, quality, spelling, substring_dedup, token_files
from millrace.llm.shared import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), digests=True)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), to)
    return token_files.read_tokens(spark, to)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(_table(spark, sf_dir, "documents"), jaccard_join.Measure(k=3, num=90, den=100))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_pieces(_table(spark, sf_dir, "documents"), digests=True)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.dictionary(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_text": op3_html_text,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_files": op7_token_files,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_nearest": op9_nearest,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling": op13_spelling,
}

ORACLES = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
hit AS (SELECT h.doc_id, h.s FROM h JOIN f ON h.k = f.k AND f.first < h.doc_id),
gone AS (SELECT DISTINCT doc_id, s + o AS pos FROM hit, range(0, 50) AS r(o)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT word.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed,
         coalesce(string_agg(x, ' ' ORDER BY word.pos) FILTER (WHERE gone.pos IS NULL), '') AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, line, pos, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS pos FROM d)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS cm FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * cm >= 90 * (x.n + y.n - cm)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(seen) FROM r WHERE r.node = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, c.n),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w) * c.n) // c.l) AS m FROM d, c),
s AS (SELECT q.item_id, m.r, m.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
      FROM q JOIN p ON p.t = q.t JOIN f ON f.t = q.t JOIN m ON m.r = p.r GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_spelling": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run GROUP BY doc_id, w),
crc AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i+1])::BIGINT)),
        lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each, tab),
dict AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM crc GROUP BY 1 HAVING len(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || chr(1) || substr(word, i::INT + 2) AS hole, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS less FROM (SELECT word, n, unnest(range(len(word))) AS i FROM dict)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n, a.n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
   UNION SELECT d.word, c.word, c.n, d.n FROM cut c JOIN dict d ON c.less = d.word UNION SELECT c.word, d.word, d.n, c.n FROM cut c JOIN dict d ON c.less = d.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
form AS (SELECT near.word, min(other) AS form, any_value(top) AS form_n FROM near JOIN best ON best.word = near.word AND other_n = top AND top >= 2 * near.n GROUP BY near.word),
chain AS (SELECT word, word AS stop, 0 AS depth FROM dict UNION ALL SELECT chain.word, form.form, depth + 1 FROM chain JOIN form ON form.word = chain.stop),
ends AS (SELECT word, arg_max(stop, depth) AS root FROM chain GROUP BY word)
SELECT dict.word, form.form, ends.root, dict.n, coalesce(best.n_near, 0)::BIGINT AS n_near, form.form_n
FROM dict JOIN ends ON ends.word = dict.word LEFT JOIN best ON best.word = dict.word LEFT JOIN form ON form.word = dict.word""",
}
