"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    byte_bpe,
    collocations,
    common,
    decontamination,
    fill_middle,
    html_template,
    minhash_dedup,
    packing,
    pitman_yor,
    quality_rules,
    secret_ledger,
    substring_dedup,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.judge(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


@query()
def op2_html_template(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.extract(table(spark, folder, "pages"))


@query()
def op3_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write(table(spark, folder, "pages"), common.new_path(spark, "warc"))
    return warc.read(manifest).drop("payload", "url")


@query(
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], chr(32)) AS sh
  FROM words, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.node = d.doc_id
"""
)
def op4_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"))


@query()
def op5_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score(table(spark, folder, "documents"))


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    index = toxicity.fit(docs, table(spark, folder, "labels").where(fold != 0))
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    scored = toxicity.score(docs, index)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query(
    r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], chr(32)) AS win
  FROM words, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20
), repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM windows
  ) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM repeated, range(0, 20) AS r(d)
), places AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM words
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS txt
  FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
), n_gone AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.txt, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id) LEFT JOIN n_gone n USING (doc_id)
"""
)
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, folder, "documents"))
    return byte_bpe.digests(byte_bpe.decode(encoded.drop("piece_offsets")))


@query()
def op9_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    ledger = secret_ledger.Ledger(spark, common.new_path(spark, "secrets"))
    paths = ledger.scan(table(spark, folder, "documents"))
    return secret_ledger.digests(secret_ledger.spans_of_paths(paths, ledger.findings()))


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    forest = quality_rules.train(docs, table(spark, folder, "labels"))
    return quality_rules.judge(docs, forest)


@query(
    r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS hx FROM documents
), draws AS (
  SELECT doc_id, t, n, ('0x' || substr(hx, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(hx, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(hx, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(hx, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM base
), cuts AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM draws
), parts AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
)
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.transform(table(spark, folder, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )


@query()
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query(
    r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece FROM (
    SELECT *, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM cut
), totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM (
    SELECT lang, m, array_to_string(ws[i:i+m-1], ' ') AS phrase FROM (
      SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3, 4, 5]) AS m FROM pieces WHERE len(ws) > 0))
  ) GROUP BY lang, phrase HAVING count(*) >= 100
), frequent AS (SELECT *, string_split(phrase, ' ') AS ws FROM grams WHERE m >= 2
), inside AS (
  SELECT lang, array_to_string(ws[i:i+k-1], ' ') AS phrase, max(f) AS longer FROM (
    SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM frequent WHERE m > 2)
  ) GROUP BY 1, 2
), kept AS (
  SELECT c.* FROM frequent c LEFT JOIN inside d ON d.lang = c.lang AND d.phrase = c.phrase WHERE d.longer IS NULL OR 100 * d.longer < 100 * c.f
), parts AS (
  SELECT lang, phrase, f, k, array_to_string(ws[1:k], ' ') AS first_part, array_to_string(ws[k+1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * p.f * t.n) // (x.f::HUGEINT * y.f) AS score, k
  FROM parts p JOIN totals t ON t.lang = p.lang
  JOIN grams x ON x.lang = p.lang AND x.phrase = p.first_part
  JOIN grams y ON y.lang = p.lang AND y.phrase = p.rest
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
  score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""
)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.collocations(table(spark, folder, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
