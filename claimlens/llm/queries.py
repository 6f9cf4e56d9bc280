"""One registered query per operator, over its whole table.

Each query calls its operator and derives the columns that are compared
from the operator's real output. ``ORACLE_SQL`` has DuckDB SQL where SQL can
state the result; the other queries have brute-force tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, hard_negatives, lm_score, ngram_join, phrase_mining, piece_codec, substring_dedup, suffix_dedup, token_pack, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_file(name: str) -> str:
    """Path of a public tokenizer's file, installed beside Python on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; of each the largest id stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows of two folds of three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.expr("crc32(cast(doc_id as string)) % 3 = 1")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", F.expr("cast(score >= 0.7 as int)").alias("predicted"))


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"), shingle=3, similarity=0.9)


ORACLE_SQL["op8_ngram_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + 2], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = d.doc_id"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that occur in them, up to the error budget."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return piece_codec.digests(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without 13-word windows of documents with smaller ids."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 13, finish=substring_dedup.as_digest,
                                          schema="doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL["op10_substring_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, w FROM docs WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 12], ' ')) AS k FROM starts
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT x.doc_id, unnest(range(s, s + 13)) AS p FROM windows x JOIN firsts f USING (k) WHERE f.first_id < x.doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""


@query
def op2_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in ascending order of id, read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_pack.write_tokens(docs, vocabulary_file("word_bpe_49k.json"), token_pack.new_folder(docs), end_id=1)
    return token_pack.read_digests(manifest)


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without 200-byte strings that occur elsewhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 200, finish=suffix_dedup.as_digest,
                                       schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learnt from four folds of five; the mixer learns from each token before the next."""
    training = F.expr("crc32(cast(doc_id as string)) % 5 <> 1")
    return lm_score.score(table(spark, sf_dir, "documents"), training, batch=0)


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one that says control strings, read back from ids and masks."""
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
                                 F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    vocabulary = dict(path=vocabulary_file("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, first_reserved=50257)
    parts = chat_format.format_conversations(turns.unionByName(said), **vocabulary)
    return chat_format.digests(parts, **vocabulary).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: controls: the length of a turn's two control strings; escapes: one backslash for each control string inside a text
ORACLE_SQL["op11_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 23 + length(role) END AS controls,
         len(regexp_extract_all(text, '<\\*<SYS>>|<\\*</SYS>>|\[\\*INST\]|\[\\*/INST\]|<\\*s>|<\\*/s>|<\\*\|role\|>|<\\*\|text\|>|<\\*\|end\|>')) AS escapes
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(sum(length(text) + escapes + controls) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return hard_negatives.mine(vectors, F.expr("vec_id % 100 = 0"))


ORACLE_SQL["op12_hard_negatives"] = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT n.anchor_id, n.positive_id, row_number() OVER (PARTITION BY n.anchor_id, n.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, n.positive_score, s.score AS negative_score
FROM near n JOIN scored s ON n.anchor_id = s.anchor_id AND NOT s.same AND 80 * n.positive_score <= 100 * s.score AND s.score <= n.positive_score
QUALIFY rank <= 5"""


@query
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language."""
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM pieces
), grams AS (
  SELECT lang, w[k : k + size - 1] AS g, size, count(*) AS f
  FROM places, (VALUES (1), (2), (3)) AS sizes(size) WHERE k + size - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM grams WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[: k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[k + 1 :]
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part, max(f) AS longer FROM (SELECT lang, unnest([g[: 2], g[2 :]]) AS part, f FROM candidates WHERE size = 3) GROUP BY ALL
), ranked AS (
  SELECT c.*, array_to_string(c.g, ' ') AS phrase,
         row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, array_to_string(c.g, ' ')) AS rank
  FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.g WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a
)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000"""
