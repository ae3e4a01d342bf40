"""The registered queries: each operator with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, chunking, classifier, compression, formatting, katz, minhash, mixing, packing, quality, resharding, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2)


ORACLES["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN coalesce(len(words), 0) = 0 THEN []
    WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingles FROM w
), c AS (
  SELECT shingles, min(doc_id) AS rep, len(shingles) AS n, row_number() OVER () AS class
  FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM s) WHERE len(shingles) > 0 GROUP BY shingles
), e AS (
  SELECT rep, n, unnest(shingles) AS shingle FROM c
), common AS (
  SELECT x.rep AS a, y.rep AS b, any_value(x.n) + any_value(y.n) AS total, count(*) AS shared
  FROM e x JOIN e y ON x.shingle = y.shingle AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * shared >= 80 * (total - shared)
), reach(node, other) AS (
  SELECT rep, rep FROM c
  UNION SELECT r.node, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.other IN (l.a, l.b)
), component AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
       coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.shingles) = c.shingles LEFT JOIN component ON c.rep = component.node
"""


@query
def op5_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op10_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by id hash to 40 of equal bytes."""
    old = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(32)), F.lit(0))
    placed = resharding.reshard(documents(spark, sf_dir), old, 40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, F.col("old").alias("old_shard"))


@query
def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@query
def op3_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


@query
def op9_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprints(documents(spark, sf_dir))


@query
def op8_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage, with the document that has it first."""
    return chaining.passages(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(name).alias("label"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), labels(spark, sf_dir, "quality"))


@query
def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(documents(spark, sf_dir), labels(spark, sf_dir, "toxic"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def op11_norm_of_sum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compress(embeddings(spark, sf_dir)).drop("scanned")


def _codes_sql() -> str:
    """Every round scans all entries; products of whole numbers are exact in doubles here."""
    assign = """a{r} AS MATERIALIZED (
  SELECT id, vec_id, label, part, x, arg_min(e, far * 256 + e) AS e, CAST(min(far) AS BIGINT) AS far FROM (
    SELECT p.*, c.e, list_dot_product(p.x, p.x) + list_dot_product(c.x, c.x) - 2 * list_dot_product(p.x, c.x) AS far FROM pieces p JOIN c{r} c USING (part))
  GROUP BY ALL)"""
    update = """c{n} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT part, e, list(mean ORDER BY i) AS x FROM (
      SELECT part, e, i, floor(sum(v) / count(*)) AS mean FROM (SELECT part, e, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM a{r}) GROUP BY part, e, i)
    GROUP BY part, e) m USING (part, e))"""
    steps = [s for r in range(4) for s in (assign.format(r=r), update.format(r=r, n=r + 1))]
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), pieces AS MATERIALIZED (
  SELECT id, vec_id, label, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM kept, range(4) t(part)
), c0 AS MATERIALIZED (
  SELECT part, e - 1 AS e, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS e FROM pieces) WHERE e <= 256
), {", ".join(steps)}, {assign.format(r=4)},
book AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256
  FROM (SELECT part, e, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM c4)
), coded AS (
  SELECT id, vec_id, label, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a4 GROUP BY id, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""


ORACLES["op11_norm_of_sum_codes"] = _codes_sql()

#: Holds control strings in both of its texts.
PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


@query
def op12_schema_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has one turn a row; conversation -7 is one JSON record with a list of messages."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.struct("role", "text").alias("record"))
    turns = formatting.canonical_turns(rows, "conv_id", "turn", "record")
    probe = spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(0).alias("turn"), F.lit(PROBE).alias("record"))
    turns = turns.unionByName(formatting.canonical_turns(probe, "conv_id", "turn", "record"))
    return formatting.read_back(formatting.format_turns(turns))


def _format_sql() -> str:
    template = formatting.Template()
    escaped = "replace(coalesce({0}, ''), '\\', '\\\\')"
    for control in template.controls():
        escaped = f"replace({escaped}, '{control}', '{template.escapes()[control[0]] + control[1:]}')"
    marks = len(template.opening + template.middle + template.closing)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length({escaped.format("role")}) + length({escaped.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


ORACLES["op12_schema_chat_format"] = _format_sql()


@query
def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))
