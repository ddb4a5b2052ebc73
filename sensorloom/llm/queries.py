"""Registered queries of this package with their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import (
    chat,
    collocations,
    contamination,
    hard_negatives,
    host_rules,
    katz,
    packing,
    page_text,
    passages,
    simhash,
    site_lines,
    toxicity,
    vector_copies,
)
from sensorloom.llm.tables import ready

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, for a session that is ready for the operators."""
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from the documents whose crc32 of the id is not divisible by ten."""
    learnable = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    return katz.score_texts(table(spark, folder, "documents").select("doc_id", "text"), learnable)


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def site_line_removal(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return site_lines.drop_boilerplate_lines(docs, n_chars="n_chars", dropped="n_dropped_lines").select(
        "doc_id", "source", "text", "n_chars", "n_dropped_lines"
    )


def host_judged(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return host_rules.judge_documents(docs).drop("source", "text")


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def extracted(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract_main_text(table(spark, folder, "pages"))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    machine = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), learnable=~held_out)
    return toxicity.score_toxicity(docs, machine).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def formatted(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    text = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(added)))


FORMATTED_SQL = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
rendered AS (
  SELECT *, (length(text) - length(replace(text, '### ', ''))) // 4
            + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + length(text) - length(replace(text, '\', '')) AS escapes
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + escapes + 14) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id"""

def repeated(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def site_lines_sql(source: str = "documents", ratio: float = 0.1, least: int = 5) -> str:
    """CTEs up to ``cleaned``: every column of ``source``, with new text and n_chars, and n_dropped_lines."""
    strip = r"trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""site_rows AS (SELECT *, row_number() OVER () AS row_key, coalesce('=' || source, '-') AS host_key FROM {source}),
site_docs AS (SELECT *, min(row_key) OVER (PARTITION BY host_key, coalesce(text, '')) AS page_key FROM site_rows),
site_split AS (
  SELECT row_key, page_key, host_key, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM site_docs),
site_stripped AS (SELECT *, {strip} AS stripped FROM site_split),
site_bad AS (
  SELECT host_key, stripped FROM (
    SELECT host_key, stripped, count(DISTINCT page_key) AS pages FROM site_stripped WHERE stripped <> '' GROUP BY ALL)
  JOIN (SELECT host_key, count(DISTINCT page_key) AS host_pages FROM site_docs GROUP BY ALL) USING (host_key)
  WHERE pages >= {least} AND pages > {ratio} * host_pages),
site_joined AS (
  SELECT s.row_key, string_agg(s.line, chr(10) ORDER BY s.place) FILTER (b.stripped IS NULL) AS new_text,
         count(b.stripped) AS n_dropped_lines
  FROM site_stripped s LEFT JOIN site_bad b ON s.host_key = b.host_key AND s.stripped = b.stripped GROUP BY ALL),
cleaned AS (
  SELECT d.* EXCLUDE (row_key, page_key, host_key) REPLACE (
           CASE WHEN text IS NOT NULL THEN coalesce(new_text, '') END AS text,
           CASE WHEN text IS NOT NULL THEN length(coalesce(new_text, '')) END AS n_chars),
         n_dropped_lines
  FROM site_docs d JOIN site_joined USING (row_key))"""


SITE_LINES_SQL = f"WITH {site_lines_sql()} SELECT doc_id, source, text, n_chars, n_dropped_lines FROM cleaned"


def judged_sql(source: str = "documents", rules: host_rules.Rules = host_rules.Rules()) -> str:
    """CTEs up to ``judged``: every column of ``source``, the measures and the verdicts."""
    return rf"""rule_docs AS (SELECT *, row_number() OVER () AS rule_key, {WORDS_SQL} AS words FROM {source}),
rule_windows AS (
  SELECT rule_key, place, [words[place], words[place + 1], words[place + 2]] AS three
  FROM (SELECT rule_key, words, unnest(range(1, len(words) - 1)) AS place FROM rule_docs)),
rule_repeats AS (
  SELECT rule_key, count(DISTINCT word_at) AS n FROM (
    SELECT rule_key, unnest([place, place + 1, place + 2]) AS word_at FROM (
      SELECT *, count(*) OVER (PARTITION BY rule_key, three) AS times FROM rule_windows) WHERE times > 1)
  GROUP BY ALL),
rule_lines AS (
  SELECT rule_key, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rule_key, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM rule_docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
rule_measured AS (
  SELECT d.* EXCLUDE (words), CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM rule_docs d LEFT JOIN rule_lines l USING (rule_key) LEFT JOIN rule_repeats r USING (rule_key)),
rule_failures AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed
  FROM rule_measured),
rule_checked AS (
  SELECT *, base_failed OR word_chars < {rules.min_word_chars} * n_words
         OR word_chars > {rules.max_word_chars} * n_words OR n_symbols > {rules.max_symbols_per_word} * n_words
         OR 100 * n_dup_lines > {rules.max_dup_line_share_percent} * n_words AS any_failed
  FROM rule_failures),
rule_hosts AS (
  SELECT *, failed / nullif(pages, 0) AS rate FROM (
    SELECT source AS host, count(*) FILTER (NOT base_failed) AS pages,
           count(*) FILTER (any_failed AND NOT base_failed) AS failed FROM rule_checked GROUP BY ALL)),
rule_prior AS (
  SELECT mean, CASE WHEN spread > 1e-15 THEN least(1e6, greatest(0.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength
  FROM (SELECT avg(rate) AS mean, var_pop(rate) AS spread FROM rule_hosts)),
rule_verdicts AS (
  SELECT host, coalesce((failed + mean * strength) / nullif(pages + strength, 0)
               > mean + {rules.host_deviations} * sqrt(mean * (1 - mean) / (strength + 1)), false) AS host_rejected
  FROM rule_hosts, rule_prior),
judged AS (
  SELECT c.* EXCLUDE (rule_key, any_failed), v.host_rejected,
         NOT c.base_failed AND NOT (v.host_rejected AND c.any_failed) AS kept
  FROM rule_checked c JOIN rule_verdicts v ON c.source IS NOT DISTINCT FROM v.host)"""


JUDGED_SQL = f"WITH {judged_sql()} SELECT * EXCLUDE (text, lang, source, n_chars) FROM judged"


def contained_sql(source: str = "documents") -> str:
    """CTEs up to ``leaks``. Items of fewer than five words are one shingle of all their words."""
    five = "[array_to_string(words[i:i + width - 1], ' ') for i in range(1, len(words) - width + 2)]"
    return f"""leak_items AS (
  SELECT item_id, item_key, words, least(5, len(words)) AS width FROM (
    SELECT item_id, row_number() OVER () AS item_key, {WORDS_SQL.replace("text", LOWER_SQL)} AS words FROM benchmark)
  WHERE len(words) > 0),
leak_shingles AS (SELECT DISTINCT item_id, item_key, width, unnest({five}) AS shingle FROM leak_items),
leak_sizes AS (SELECT item_key, count(*) AS n_shingles FROM leak_shingles GROUP BY ALL),
leak_docs AS (SELECT *, row_number() OVER () AS row_key, {WORDS_SQL.replace("text", LOWER_SQL)} AS words FROM {source}),
leak_parts AS (
  SELECT DISTINCT row_key, width, unnest({five}) AS shingle
  FROM leak_docs, (SELECT DISTINCT width FROM leak_items) WHERE len(words) >= width),
leak_found AS (
  SELECT row_key, item_id, item_key, count(*) AS n_shared
  FROM leak_parts JOIN leak_shingles USING (width, shingle) GROUP BY ALL),
leaks AS (
  SELECT row_key, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
  FROM leak_found JOIN leak_sizes USING (item_key) WHERE n_shared >= 0.8 * n_shingles)"""


LEAKS_SQL = f"""WITH {contained_sql()}
SELECT doc_id, item_id, n_shared, n_shingles, containment FROM leaks JOIN leak_docs USING (row_key)"""


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


PHRASES_SQL = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
word_lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
windows AS (
  SELECT lang, k, words[start:start + k - 1] AS words
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS start FROM word_lists, range(1, 5) AS sizes(k))),
counts AS (SELECT lang, k, words, array_to_string(words, ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM windows GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY ALL),
candidates AS (SELECT * FROM counts WHERE k >= 2 AND f >= 30),
cuts AS (SELECT c.*, unnest(range(1, c.k)) AS cut FROM candidates c),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r, (2000000 * c.f) // (x.f + y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(words[start:start + size - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS start FROM candidates, range(2, 4) AS parts(size) WHERE size < k)),
covered AS (
  SELECT c.lang, c.phrase FROM candidates c JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  GROUP BY ALL HAVING max(CASE WHEN 100 * i.f >= 80 * c.f THEN 1 ELSE 0 END) = 1),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w ANTI JOIN covered v ON v.lang = w.lang AND v.phrase = w.phrase)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def vector_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vector_copies.near_duplicate_vectors(table(spark, folder, "embeddings"))


VECTORS_SQL = """WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
valid AS (
  SELECT * FROM vectors
  WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.k AS a, y.k AS b FROM valid x JOIN valid y ON x.label = y.label AND x.k <> y.k AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reached AS (
  SELECT k, k AS other FROM vectors UNION SELECT r.k, l.b FROM reached r JOIN links l ON l.a = r.other),
components AS (SELECT r.k, min(v.vec_id) AS component_id FROM reached r JOIN vectors v ON v.k = r.other GROUP BY ALL)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM vectors v JOIN components c USING (k) LEFT JOIN (SELECT a AS k, count(*) AS n_links FROM links GROUP BY ALL) n USING (k)"""


def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth vec_id is an anchor; every seventh has the next label instead of its own."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), lambda key: key % 100 == 0, label=moved)


NEGATIVES_SQL = """WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM valid a JOIN valid c ON len(a.e) = len(c.e) AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_katz_backoff": (language_model, None),
    "op2_best_fit_packing": (packed, None),
    "op3_simhash_near_duplicates": (near_duplicates, None),
    "op4_page_main_text": (extracted, None),
    "op5_toxicity_pairs": (toxic, None),
    "op6_repeated_passages": (repeated, None),
    "op7_site_line_removal": (site_line_removal, SITE_LINES_SQL),
    "op8_host_quality_rules": (host_judged, JUDGED_SQL),
    "op9_chat_round_trip": (formatted, FORMATTED_SQL),
    "op10_benchmark_leaks": (leaks, LEAKS_SQL),
    "op11_phrase_collocations": (phrases, PHRASES_SQL),
    "op12_vector_near_duplicates": (vector_near_duplicates, VECTORS_SQL),
    "op13_hard_negatives": (mined_negatives, NEGATIVES_SQL),
}
