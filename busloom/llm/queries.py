"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, itq, langid, licenses, lm_mixing, minhash, mixture, packing, repair, sharding, simhash, substring, toxicity


def _documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": _documents(minhash.op1_near_duplicates),
    "op2_packing": _documents(packing.op2_packing),
    "op3_lm_scores": _documents(lm_mixing.op3_lm_scores),
    "op4_substring": _documents(substring.op4_substring),
    "op5_simhash": _documents(simhash.op5_fingerprints),
    "op7_language": _documents(langid.op7_language),
    "op8_embeddings": lambda spark, sf_dir: itq.op8_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op9_toxicity": lambda spark, sf_dir: toxicity.op9_toxicity(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ),
    "op6_mixing": _documents(mixture.op6_mixing),
    "op10_sharding": _documents(sharding.op10_sharding),
    "op11_licenses": _documents(licenses.op11_licenses),
    "op12_repair": lambda spark, sf_dir: repair.op12_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op13_filter_audit": lambda spark, sf_dir: filter_audit.op13_filter_audit(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ),
}

_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)"""

#: Equal rows by brute force: all pairs that share a shingle, all windows. The other operators use
#: trained models, a tokenizer or Spark's hash; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op1_minhash": f"""WITH RECURSIVE {_WORDS},
s AS (SELECT doc_id, array_to_string(l[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
m AS (SELECT doc_id, shingle, count(*) AS c FROM s GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS weight FROM m GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS common FROM m a JOIN m b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE common >= 0.8 * (nx.weight + ny.weight - common)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r(doc_id, other) AS (SELECT x, x FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(weight, 0) AS weight, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_id, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op4_substring": f"""WITH {_WORDS},
p AS (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM w WHERE len(l) >= 35), a AS (SELECT doc_id, i, array_to_string(l[i:i + 34], ' ') AS t FROM p),
d AS (SELECT t FROM a GROUP BY t HAVING count(*) > 1), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM a JOIN d USING (t)),
b AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(l) AS n, list_filter(l, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM w LEFT JOIN b USING (doc_id))
SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op8_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(vec_id, other) AS (SELECT x, x FROM e UNION SELECT r.vec_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT vec_id, min(other) AS component FROM r GROUP BY 1), n AS (SELECT x AS vec_id, count(*) AS links FROM e GROUP BY 1)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op11_licenses": licenses.SQL,
    "op12_repair": repair.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
