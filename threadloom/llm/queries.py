"""Queries of this subpackage, one for each operator, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import bpe, langid, license_scan, media, merkle, mixing, quality, quality_rules, simhash, token_count, token_store, topk, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_checked(spark, token_store.write_store(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_and_errors(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    own = (op1_license_scan, op2_token_store, op3_quality, op4_simhash, op5_media, op6_token_count, op7_topk, op8_bpe, op9_langid, op10_mixing, op11_vector_codes, op12_merkle, op13_quality_rules)
    return {f.__name__: f for f in own}


def license_sql(templates: tuple[license_scan.Template, ...] = license_scan.TEMPLATES) -> str:
    """Every key phrase at every word that it could begin at, by comparing lists, without an index."""
    weight = license_scan.idf(templates)
    rows = []
    for t in templates:
        notice, key = t.notice.split(), t.key.split()
        at = min(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
        rows.append(f"('{t.label}', {t.base}, {listed(key)}, {at}, {listed(notice)}, [{', '.join(f'{weight[w]!r}::DOUBLE' for w in notice)}])")
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t(label, base, key, lead, notice, weights) AS (VALUES {", ".join(rows)}),
begins AS (SELECT r, words, p FROM w, (SELECT list(DISTINCT key[1]) AS firsts FROM t), unnest(list_filter(range(len(words)), lambda p: list_contains(firsts, words[p + 1]))) AS x(p)),
f AS (SELECT r, label, base, p, round(list_sum(list_transform(range(1, len(notice) + 1), lambda j: CASE WHEN p - lead + j >= 1 AND words[greatest(1, p - lead + j)] = notice[j] THEN weights[j] ELSE 0.0::DOUBLE END)) / list_sum(weights), 6) AS share
  FROM begins JOIN t ON words[p + 1] = key[1] AND words[p + 1 : p + len(key)] = key),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY r)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM w LEFT JOIN g USING (r)"""


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""

#: Each inversion's distribution is tabulated by source; a document's count is the number of steps its hash passes.
MIX_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS docs, sum(pow(n, 0.5)) AS w FROM n),
m AS (SELECT source, pow(n, 0.5) / w * docs * 1.0 / n AS mean FROM n, t),
e AS (SELECT source, greatest(1, ceil(mean / 16.0))::INTEGER AS parts, mean / greatest(1, ceil(mean / 16.0))::INTEGER AS each FROM m),
c AS (SELECT source, parts, each, 0 AS k, exp(-each) AS p, exp(-each) AS cdf FROM e
  UNION ALL SELECT source, parts, each, k + 1, p * each / (k + 1), cdf + p * each / (k + 1) FROM c WHERE k < ceil(each + 12 * sqrt(each) + 24) - 1),
u AS (SELECT d.doc_id, d.source, i, ('0x' || substr(md5(d.doc_id || ':' || i || ':mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN (SELECT DISTINCT source, parts FROM e) e ON d.source IS NOT DISTINCT FROM e.source, unnest(range(1, parts + 1)) AS x(i)),
k AS (SELECT doc_id, u.source, count(c.k) AS copies FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND u.u >= c.cdf GROUP BY doc_id, u.source)
SELECT d.*, x.copy_no::INTEGER AS copy_no, md5(d.doc_id || ':' || x.copy_no || ':mix-1:order') AS mix_key
FROM documents d JOIN k USING (doc_id), unnest(range(0, copies)) AS x(copy_no)"""


def codes_sql(rounds: int = 6) -> str:
    """Every part against every entry, a common table for each round."""
    out = """
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, s, v[s * len(v) // 8 + 1 : (s + 1) * len(v) // 8] AS x FROM k, range(8) AS t(s)),
c0 AS MATERIALIZED (SELECT s, e - 1 AS e, x AS c FROM (SELECT s, x, row_number() OVER (PARTITION BY s ORDER BY vec_id) AS e FROM p) WHERE e <= 16)"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, s, min({{'d': d, 'e': e}}) AS m, any_value(x) AS x FROM (SELECT vec_id, s, e, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM p JOIN c{r} USING (s)) GROUP BY vec_id, s)"""
        if r < rounds:
            out += f""",
n{r} AS (SELECT s, e, list((t - ((t % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT s, m.e AS e, j, sum(x[j])::BIGINT AS t, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) AS u(j) GROUP BY ALL) GROUP BY s, e),
c{r + 1} AS MATERIALIZED (SELECT s, e, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (s, e))"""
    return out + f""",
g AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY s) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY s, e)) FROM c{rounds}) AS codebooks_sha256 FROM g JOIN k USING (vec_id)"""


_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
#: CRC-32 bit by bit over the digits of the id; both kinds of tree (k 0: of a source, 1: over the subroots) climb by the same recursion.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF("text")} AS leaf, {_LEAF("replace(text, chr(10), '')")} AS changed,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda z, i: CASE WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END)), 4294967295) % 2 = 0 AS trial FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
low AS (SELECT source, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL SELECT source, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY source, level, idx // 3),
sub AS (SELECT source, h, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE n = 1),
high AS (SELECT 0 AS level, place AS idx, h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, idx // 3),
nodes AS (SELECT 0 AS k, coalesce('s' || source, '') AS t, level, idx, h FROM low WHERE n > 1 UNION ALL SELECT 1, '', level, idx, h FROM high WHERE n > 1),
up AS (SELECT k, t, level, idx, h AS own, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM nodes WINDOW w AS (PARTITION BY k, t, level, idx // 3 ORDER BY idx)),
f AS (SELECT row_number() OVER () AS id, doc_id, source, leaf, 0 AS k, 0 AS level, idx, CASE WHEN trial THEN coalesce(changed, leaf) ELSE leaf END AS h, '' AS proof FROM l
  UNION ALL SELECT id, doc_id, f.source, leaf, CASE WHEN up.k IS NULL THEN 1 ELSE f.k END, CASE WHEN up.k IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN up.k IS NULL THEN sub.place ELSE f.idx // 3 END,
    CASE WHEN up.k IS NULL THEN f.h ELSE sha256(a || f.h || b) END, proof || coalesce(a || b, '')
  FROM f JOIN sub ON sub.source IS NOT DISTINCT FROM f.source LEFT JOIN up ON up.k = f.k AND up.t = CASE WHEN f.k = 0 THEN coalesce('s' || f.source, '') ELSE '' END AND up.level = f.level AND up.idx = f.idx
  WHERE up.k IS NOT NULL OR f.k = 0),
e AS (SELECT id, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(leaf) AS leaf, arg_max(h, k * 1000 + level) AS folded_root, sha256(arg_max(proof, k * 1000 + level)) AS proof_sha256 FROM f GROUP BY id)
SELECT doc_id, leaf, sub.h AS subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified FROM e JOIN sub ON sub.source IS NOT DISTINCT FROM e.source, (SELECT h FROM high WHERE n = 1) r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_sql(), "op7_topk": TOPK_SQL, "op10_mixing": MIX_SQL, "op11_vector_codes": codes_sql(), "op12_merkle": MERKLE_SQL}
