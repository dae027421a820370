"""The queries of the llm operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_documents

    return score_documents(table(spark, sf_dir, "documents"), mod=7, rest=2)


def op2_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contained

    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linespread import remove_boilerplate

    out = remove_boilerplate(table(spark, sf_dir, "documents"), least=10)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), k=4, most=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flatgraph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nbsvm import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=5, rest=0, threshold=0.3)


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf import score_toxicity

    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=4, rest=2, threshold=0.3)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import copies

    out = copies(table(spark, sf_dir, "documents"), share=1.5, most=2.0, weights=(3, 1, 2), seed=42)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz_backoff, op2_anchor_dedup, op3_decontaminate, op4_line_spread, op5_simhash, op6_flat_graph, op7_minimax_shards, op8_nbsvm_quality, op9_crf_toxicity, op10_mix_sources)}


_WORD = r"'[^\x20\x09-\x0D]+'"
_FOLDED = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i:i+4],' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w)-4,1)+1)) AS i
 FROM (SELECT {key}, regexp_extract_all({_FOLDED}, {_WORD}) AS w FROM {table}) WHERE len(w)>0))"""


_ORACLES = {
    "op2_anchor_dedup": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text,''),{_WORD}) AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i+12],' ') AS s FROM (SELECT doc_id, w, unnest(range(1,len(w)-11)) AS i FROM w WHERE len(w)>=13)),
 m AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s), bad AS (SELECT win.doc_id, i FROM win JOIN m ON win.s=m.s WHERE d<win.doc_id),
 gone AS (SELECT DISTINCT doc_id, i+k AS p FROM bad, range(0,13) t(k)), pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w,1) AS p FROM w),
 k AS (SELECT pos.doc_id, count(gone.p) AS n_removed, string_agg(x,' ' ORDER BY pos.p) FILTER (WHERE gone.p IS NULL) AS kept FROM pos LEFT JOIN gone ON pos.doc_id=gone.doc_id AND pos.p=gone.p GROUP BY pos.doc_id)
 SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed,0) AS BIGINT) AS n_removed, sha256(coalesce(kept,'')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id=k.doc_id""",
    "op3_decontaminate": f"""WITH d AS {_shingles("documents", "doc_id")}, b AS {_shingles("benchmark", "item_id")}, q AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
 SELECT doc_id, b.item_id, CAST(any_value(n) AS BIGINT) AS n_item_shingles, CAST(count(*) AS BIGINT) AS n_common, CAST(count(*) AS DOUBLE)/any_value(n) AS containment
 FROM b JOIN d ON b.s=d.s JOIN q ON q.item_id=b.item_id GROUP BY doc_id, b.item_id HAVING count(*) >= ceil(0.8*any_value(n)-1e-9)""",
    "op4_line_spread": """WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text,''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text,''), chr(10)),1) AS p FROM documents),
 bad AS (SELECT trim(x,' ') AS x FROM l WHERE trim(x,' ')<>'' GROUP BY ALL HAVING count(DISTINCT coalesce('='||source,'null'))>=10)
 SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(bad.x) AS BIGINT) AS n_removed, md5(coalesce(string_agg(l.x, chr(10) ORDER BY p) FILTER (WHERE bad.x IS NULL),'')) AS kept_md5
 FROM l LEFT JOIN bad ON trim(l.x,' ')=bad.x GROUP BY doc_id""",
    "op6_flat_graph": """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id<>b.vec_id AND list_cosine_similarity(a.v,b.v)>=0.95),
 r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, k.b FROM r JOIN k ON r.b=k.a)
 SELECT e.vec_id, (SELECT count(*) FROM k WHERE k.a=e.vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a=e.vec_id) AS component_id, (SELECT min(b) FROM r WHERE r.a=e.vec_id)=e.vec_id AS kept FROM e""",
    "op10_mix_sources": f"""WITH w AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''),{_WORD})) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM w GROUP BY source), o AS (SELECT *, ([3.0::DOUBLE,1.0::DOUBLE,2.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1] AS wt, n*2.0::DOUBLE AS cap FROM s),
 x AS (SELECT *, CAST(sum(n) OVER () AS DOUBLE)*1.5::DOUBLE AS goal, coalesce(sum(cap) OVER (ORDER BY cap/wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS capped, sum(wt) OVER (ORDER BY cap/wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
 y AS (SELECT *, (goal-capped)/rest AS lv FROM x), z AS (SELECT source, n, CASE WHEN n=0 THEN 0.0::DOUBLE ELSE least(cap, coalesce((SELECT max(lv) FROM y WHERE lv*wt<=cap),'inf'::DOUBLE)*wt) END AS target FROM y)
 SELECT doc_id, size, z.n AS source_size, target, CAST(size*(floor(target/z.n) + CASE WHEN CAST(CAST('0x'||substr(md5('42:'||doc_id),1,13) AS BIGINT) AS DOUBLE)/4503599627370496.0::DOUBLE < target/z.n-floor(target/z.n) THEN 1 ELSE 0 END) AS BIGINT) AS taken
 FROM w JOIN z ON w.source IS NOT DISTINCT FROM z.source""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
