"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import (
    bpe,
    decontaminate,
    jaccard,
    mixing,
    periodic,
    phrases,
    pii,
    quality,
    repeats,
    simple8b,
    vectorcodes,
    warc,
    wrappers,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# The key of a deployment comes from its own secret store.
PII_KEY = "a key of the demonstration"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_wrappers")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrappers.extract_pages(_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, pattern, remembered=500_000).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query("op3_quality_cascade", r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (
  SELECT doc_id, unnest(range(len(w) - 7)) AS i, w FROM words WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS s FROM spots),
repeated AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n FROM repeated GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS marks, coalesce(lines.n, 0) AS n_lines
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * marks > n_words
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words) AS kept
FROM b""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_decontamination", r"""
WITH norm AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM documents),
items AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM benchmark),
long_items AS (SELECT item_id, w, len(w) AS n FROM items WHERE len(w) >= 5),
iq AS (SELECT item_id, n, w, unnest(range(n - 4)) AS q FROM long_items),
ish AS (SELECT item_id, n, q, array_to_string(w[q + 1 : q + 5], ' ') AS s FROM iq),
dp AS (SELECT doc_id, w, unnest(range(len(w) - 4)) AS p FROM norm WHERE len(w) >= 5),
dsh AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM dp),
pairs AS (
  SELECT DISTINCT dsh.doc_id, ish.item_id, ish.n, dsh.p - ish.q AS start FROM dsh JOIN ish USING (s)),
spans AS (
  SELECT pairs.*, greatest(start, 0) AS first, least(start + pairs.n, len(norm.w)) AS stop
  FROM pairs JOIN norm USING (doc_id)),
ours AS (
  SELECT spans.doc_id, spans.item_id, spans.start, dsh.s, count(*) AS n1
  FROM spans JOIN dsh ON dsh.doc_id = spans.doc_id AND dsh.p BETWEEN spans.first AND spans.stop - 5
  GROUP BY ALL),
theirs AS (SELECT item_id, s, count(*) AS n2 FROM ish GROUP BY ALL),
shared AS (
  SELECT doc_id, item_id, start, CAST(sum(least(n1, n2)) AS BIGINT) AS b
  FROM ours JOIN theirs USING (item_id, s) GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, start, b, (stop - first - 4) + (spans.n - 4) - b AS u
  FROM shared JOIN spans USING (doc_id, item_id, start))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(b AS DOUBLE) / u AS similarity
FROM scored WHERE 100 * b >= 80 * u
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(b AS DOUBLE) / u DESC, start) = 1""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op5_warc_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.capture(_table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op6_token_id_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    read = simple8b.read_ids(simple8b.write_ids(_table(spark, sf_dir, "documents"), path))
    return read.select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op8_repeated_phrases")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = phrases.remove_repeated_phrases(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "n_values", "text")


@query("op10_maximal_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _codes_sql(rounds: int = 4) -> str:
    """The codebooks round by round; floats hold these whole numbers exactly."""
    steps = [
        """v AS (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, p, v[16 * p + 1 : 16 * p + 16] AS x FROM v, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 256)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p.p, x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}}) AS best
  FROM p JOIN c{r} ON p.p = c{r}.p GROUP BY ALL)""")
        if r < rounds:
            sums = ", ".join(f"floor(sum(x[{i}]) / count(*))" for i in range(1, 17))
            steps.append(f"""m{r} AS (SELECT p, best.e AS e, [{sums}] AS m FROM a{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.e, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.p = c{r}.p AND m{r}.e = c{r}.e)""")
    return f"""WITH {", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
named AS (SELECT vec_id, code, error, label FROM coded JOIN v USING (vec_id)),
books AS (
  SELECT sha256(string_agg(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in c], ','), ',' ORDER BY p, e)) AS digest
  FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM named, books"""


@query("op11_gnat_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(_table(spark, sf_dir, "embeddings"))


@query("op12_source_schedule", r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sums),
-- Sources reach their limit in the order of limit by weight.
filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest
  FROM ranked WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT capped, rest FROM filled WHERE weight * (3 * total - 2 * capped) <= 4 * source_size * rest
  ORDER BY capped, rest DESC LIMIT 1),
targets AS (
  SELECT ranked.*, CASE WHEN weight * (3 * total - 2 * capped) > 4 * source_size * rest THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * (3 * total - 2 * capped) AS DOUBLE) / (2 * rest) END AS target
  FROM ranked LEFT JOIN level ON TRUE),
laid AS (
  SELECT sized.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS t,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, t) - start) + greatest(0, least(start + size, t - source_size) - start) AS BIGINT) AS taken
FROM laid""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(_table(spark, sf_dir, "documents"), periodic.periodic_tail)
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.array_join(F.transform(line, lambda text: F.concat(text, F.lit("\n"))), "")
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
