"""The queries of the ten operators, over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive import nearest_neighbours
from .common import fold_of, read_table
from .licenses import document_licences, fit_licences
from .linedup import drop_repeated_lines
from .packing import ids_crc32, packed
from .phrases import collocations
from .pii import KINDS, fit_field, with_personal_data
from .probminhash import near_duplicates
from .quality import fit_quality, quality_score
from .sentencepiece import PieceModel, encoded
from .sharding import shard_documents
from .toxicity import fit_toxicity, toxicity_score
from .vafile import exact_top_k
from .vakmeans import centroid_clusters


def quality_model(spark: SparkSession, sf_dir: str):
    labels = read_table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 4) != 2)
    return fit_quality(read_table(spark, sf_dir, "documents"), labels)


def toxicity_model(spark: SparkSession, sf_dir: str):
    labels = read_table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 5) != 0)
    return fit_toxicity(read_table(spark, sf_dir, "documents"), labels)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id is in no fold: held_out is null; it is scored like all rows."""
    score = quality_score("text", quality_model(spark, sf_dir))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(read_table(spark, sf_dir, "documents"), PieceModel.load(public_tokenizers.path("piece_bpe_32k.model")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


#: The mixture of the packing: a fifth of every window is of the largest source and a twentieth of each of two others,
#: for as long as they last; all others divide the rest by size.
MIXTURE = {"src0": 0.2, "src1": 0.05, "src2": 0.05}


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(read_table(spark, sf_dir, "documents"), targets=MIXTURE)
    return pieces.select("doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id is in no fold: held_out is null; it is scored like all rows."""
    score = toxicity_score("text", toxicity_model(spark, sf_dir))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return document_licences(documents, fit_licences(documents))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "class_size")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read_table(spark, sf_dir, "documents"), counts=("lines", "removed")).select("doc_id", "lines", "removed", "text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the base spans; `spans` has the field's as well."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_personal_data(documents, fit_field(documents)).drop("text")
    base = F.filter("spans", lambda s: ~s["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    added = F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added")
    return rows.select("doc_id", *map(of_kind, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(read_table(spark, sf_dir, "embeddings"))


def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain k-means in SQL: a common table expression for each round."""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS i, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) AS INT) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {k})",
    ]
    near = "SELECT i, vec_id, v, cluster, list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(v, c)])::BIGINT AS distance FROM kept, c{n} QUALIFY row_number() OVER (PARTITION BY i ORDER BY distance, cluster) = 1"
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        means = "SELECT cluster, list(m ORDER BY d) AS c FROM (SELECT cluster, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS d FROM a{n}) GROUP BY cluster, d) GROUP BY cluster"
        steps.append(f"m{n} AS ({means.format(n=n)})")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m ON m.cluster = o.cluster)")
    steps.append(f"last AS MATERIALIZED ({near.format(n=rounds)})")
    steps.append(f"about AS (SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, l.cluster, distance, CAST(sum(distance) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM last l JOIN about a ON a.cluster = l.cluster"


def queries() -> dict:
    import corpus_pipeline

    found = (op1_quality, op2_sharding, op3_sentencepiece, op4_packing, op5_toxicity, op6_licences, op7_exact_top_k, op8_nearest_neighbours, op9_near_duplicates, op10_line_dedup, op11_collocations, op12_personal_data, op13_centroid_clusters)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_top_k": """
WITH flat AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
        "op10_line_dedup": """
WITH rows AS (SELECT doc_id, text, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h, string_split(text, chr(10)) AS ls FROM documents),
trimmed AS (SELECT DISTINCT doc_id, h, [trim(l, ' ') FOR l IN ls] AS tl FROM rows WHERE doc_id IS NOT NULL AND len(ls) >= 3),
windows AS (
  SELECT doc_id, h, p, tl[p + 1] AS a, tl[p + 2] AS b, tl[p + 3] AS c
  FROM (SELECT doc_id, h, tl, unnest(range(0, len(tl) - 2)) AS p FROM trimmed) WHERE tl[p + 1] || tl[p + 2] || tl[p + 3] <> ''
),
marked AS (SELECT doc_id, h, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, h, p) AS n FROM windows),
covered AS (SELECT DISTINCT doc_id, h, p + o AS p FROM marked, (VALUES (0), (1), (2)) AS t(o) WHERE n > 1),
gone AS (SELECT doc_id, h, list(p) AS ps FROM covered GROUP BY doc_id, h)
SELECT r.doc_id, CAST(CASE WHEN r.text IS NULL THEN 0 ELSE len(ls) END AS INT) AS lines, CAST(coalesce(len(ps), 0) AS INT) AS removed,
  CASE WHEN ps IS NULL THEN r.text ELSE coalesce(array_to_string([ls[i + 1] FOR i IN range(0, len(ls)) IF NOT list_contains(ps, i)], chr(10)), '') END AS text
FROM rows r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.h = g.h""",
        "op11_collocations": """
WITH words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM candidates, (VALUES (1), (2)) AS t(c) WHERE c < k),
scored AS (
  SELECT x.lang, x.phrase, a, c, p.f AS l, q.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
  FROM cuts x JOIN counts p ON p.lang = x.lang AND p.phrase = x.lp JOIN counts q ON q.lang = x.lang AND q.phrase = x.rp
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE k = 3) GROUP BY lang, part),
ranked AS (
  SELECT b.*, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * a
)
SELECT x.lang, rank, phrase, a, l, r, n, score FROM ranked x JOIN sizes s ON s.lang = x.lang WHERE rank <= 2000""",
        "op13_centroid_clusters": _kmeans_sql(),
    }
