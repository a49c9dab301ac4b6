"""Queries over responses of services and over what of a question must stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as an
from .registry import query
from .views import table

HEADS = ("What did NASA and the EU-UN sign in 1995? ", "Tell me: The New Zealand Article 12 and section  7 of GDP/GNP. Then Japan. ", "please compare germany, China and brazil since 2101 and 1499. ", "United Kingdom! Peru? It was Kenya ", "I want it. ")
_head = "CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " END"
_starters = ", ".join(f"'{w}'" for w in an.STARTERS)
_not = lambda items: f"list_filter({items}, lambda x: lower(x) NOT IN ({_starters}))"


@query("preserved_tokens", f"""WITH k AS (SELECT list(lower(n_name)) AS known FROM nation), q AS (SELECT conv_id, turn, {_head} || text AS q FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7F]')),
t AS (SELECT *, regexp_replace(regexp_replace(q, '^[A-Z][a-z]{{2,}}\\b', ''), '([.!?]\\s?)[A-Z][a-z]{{2,}}\\b', '\\1', 'g') AS inner_ FROM q),
c AS (SELECT conv_id, turn, list_concat(regexp_extract_all(q, '\\b(?:1[5-9][0-9][0-9]|2[01][0-9][0-9])\\b'), regexp_extract_all(q, '(?i)\\b(?:article|section|chapter|clause|paragraph|title|amendment)\\s+[0-9]+\\b'),
  {_not("regexp_extract_all(q, '\\b[A-Z]{2,6}(?:[/-][A-Z]{2,6})*\\b')")},
  {_not("flatten(list_transform(regexp_extract_all(q, '\\b[A-Z][a-z]{2,}(?:\\s+[A-Z][a-z]{2,})+\\b'), lambda n: string_split_regex(n, '\\s+')))")},
  {_not("regexp_extract_all(inner_, '\\b[A-Z][a-z]{2,}\\b')")}, list_filter(regexp_extract_all(lower(q), '[a-z]+'), lambda w: list_contains(known, w))) AS l FROM t, k)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS tokens FROM c""")
def preserved_tokens(spark, sf):
    """Years, articles, acronyms and names of questions; the names of nations are a table."""
    known = table(spark, sf, "nation").agg(F.collect_list(F.lower("n_name")).alias("known"))  # a row for a table of fixed size
    rows = table(spark, sf, "conversations").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[^\x00-\x7F]"))
    asked = rows.select("conv_id", "turn", F.concat(F.expr(_head), "text").alias("q")).crossJoin(F.broadcast(known))
    return asked.select("conv_id", "turn", F.array_join(an.preserved(F.col("q"), F.col("known")), "|").alias("tokens"))


_at = "CASE WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 13 = 5 THEN 0 WHEN vec_id % 17 = 4 THEN 99 ELSE vec_id * 5 % 8 END"


@query("placed_vectors", f"""WITH RECURSIVE i AS (SELECT vec_id // 8 AS batch, vec_id, {_at} AS place_, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id DESC) AS n FROM embeddings WHERE vec_id % 7 <> 6),
go AS (SELECT DISTINCT batch, 0 AS n, list_transform(range(8), lambda x: CAST(NULL AS BIGINT)) AS slots FROM i
  UNION ALL SELECT go.batch, i.n::INTEGER, list_transform(range(8), lambda j: CASE WHEN j = coalesce(place_, list_position(list_transform(slots, lambda s: s IS NULL), true) - 1) THEN CASE WHEN vec_id % 19 = 0 THEN NULL ELSE vec_id END ELSE slots[j + 1] END) FROM go JOIN i ON i.batch = go.batch AND i.n = go.n + 1),
l AS (SELECT batch, slots FROM go QUALIFY row_number() OVER (PARTITION BY batch ORDER BY n DESC) = 1),
f AS (SELECT batch, unnest(range(8)) AS slot, unnest(slots) AS vec_id FROM l)
SELECT batch, slot, CASE WHEN f.vec_id IS NULL THEN '' ELSE array_to_string(list_transform(embedding, lambda x: CAST(floor(1000 * CAST(x AS DOUBLE)) AS BIGINT)), ' ') END AS vector FROM f LEFT JOIN embeddings USING (vec_id)""")
def placed_vectors(spark, sf):
    """Responses of eight places, items out of order, some without an index, some for a place that is taken or not there, some empty; each vector where it belongs."""
    rows = table(spark, sf, "embeddings").where("vec_id % 7 <> 6")
    vector = F.when(F.col("vec_id") % 19 == 0, F.array().cast("array<string>")).otherwise(F.transform("embedding", lambda x: F.floor(1000 * x.cast("double")).cast("string")))
    item = F.struct((-F.col("vec_id")).alias("o"), F.expr(_at.replace("//", "DIV")).alias("index"), F.concat(vector, F.array(F.lit("no number"))).alias("embedding"))
    sent = rows.groupBy(F.expr("vec_id DIV 8").alias("batch")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("data"))).alias("response"))  # eight items at most
    put = sent.select("batch", F.posexplode(an.placed(F.col("response"), F.lit(8))).alias("slot", "v"))
    return put.select("batch", F.col("slot").cast("long").alias("slot"), F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), " ").alias("vector"))
