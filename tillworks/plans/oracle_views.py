"""The business frames as plain SQL for the independent check engine.

Written separately from the DataFrame code: full joins, no shortcuts.
"""

from __future__ import annotations

import re

from tillworks.functions import lookups
from tillworks.functions.scalars import URL
from tillworks.sources.star_views import LEXICON, RULE_CONTRAST, RULE_MODIFIERS

KEY = r"regexp_replace({}, '[\s,.\-_]+', '', 'g')"
STANDARD = r"regexp_replace(replace(replace(lower(trim({})), '&', 'and'), ',', ''), '\s+', ' ', 'g')"
CLEAN = (
    "coalesce(trim(regexp_replace(regexp_replace(lower({}), '" + URL.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), "
    "'[^a-z0-9'']+', ' ', 'g')), '')"
)
MONTH = "CAST(date_trunc('month', {}) AS DATE)"


def pearson(x: str, y: str, places: int = 4) -> str:
    """Correlation over rows where both sides are present; NULL when undefined."""
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {both} > 1 THEN round_even(covar_pop({x}, {y}) {both} / "
        f"nullif(sqrt(var_pop({x}) {both} * var_pop({y}) {both}), 0), {places}) END"
    )


def mean(x: str, places: int = 6) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{places}))) AS DOUBLE) / nullif(count({x}), 0)"


def buckets(score: str) -> str:
    return (
        f"count(*) FILTER (WHERE {score} >= 4) AS positive_reviews, "
        f"count(*) FILTER (WHERE {score} = 3) AS neutral_reviews, "
        f"count(*) FILTER (WHERE {score} <= 2) AS negative_reviews"
    )


def labels(prefix: str = "", suffix: str = "reviews") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE sentiment_label = '{name}') AS {name.lower()}_{suffix}"
        for name in ("Positive", "Neutral", "Negative")
    )


def pct(part: str, whole: str, places: int = 2) -> str:
    return f"round_even(CAST({part} AS DOUBLE) * 100.0 / nullif(CAST({whole} AS DOUBLE), 0), {places})"


def growth(now: str, before: str, places: int = 2) -> str:
    n, b = f"CAST({now} AS DOUBLE)", f"CAST({before} AS DOUBLE)"
    return f"round_even((({n}) - ({b})) / nullif({b}, 0) * 100.0, {places})"


def trend(p: str) -> str:
    return (
        f"CASE WHEN {p} IS NULL THEN 'N/A' WHEN {p} >= 5 THEN 'Upward' WHEN {p} > 0 THEN 'Slight Upward' "
        f"WHEN {p} <= -5 THEN 'Declining' WHEN {p} < 0 THEN 'Slight Decline' ELSE 'Flat' END"
    )


def values(rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


TOPIC_ROWS = values([(i, t) for i, t in enumerate(lookups.TOPICS)])

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sales_lines": (
        (),
        f"""SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  c_name AS customer_name, n_name AS city, r_name AS region,
  p_type AS category, p_brand AS subcategory, concat(p_type, p_brand) AS product_raw,
  CAST(o_orderdate AS DATE) AS order_date, {MONTH.format('o_orderdate')} AS sales_month,
  CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS sales,
  CAST(l_discount AS DECIMAL(4,2)) AS discount,
  CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(0.06 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS profit,
  {KEY.format('concat(c_name, n_name)')} AS customer_key,
  {KEY.format('concat(p_type, p_brand)')} AS product_id,
  {STANDARD.format('p_type')} AS category_key
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    ),
    "review_events": (
        (),
        """SELECT event_id AS review_id, CAST(user_id AS VARCHAR) AS user_id,
  DATE '1998-01-01' + CAST(event_id % 1096 AS INTEGER) AS review_date,
  CAST(1 + CAST(floor(value) AS INTEGER) % 5 AS INTEGER) AS review_score,
  concat(p_brand, p_name) AS product_id, p_name AS product_name, p_type AS category,
  p_brand AS subcategory, p_name AS product_type
FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)""",
    ),
    "review_docs": (
        (),
        """SELECT d.doc_id AS review_id, DATE '1998-01-01' + CAST(d.doc_id % 1096 AS INTEGER) AS review_date,
  CAST(1 + d.n_chars % 5 AS INTEGER) AS review_score, p_type AS category, d.text AS review_text,
  d.doc_id % (SELECT count(*) FROM embeddings) AS vec_id
FROM documents d JOIN part ON p_partkey = d.doc_id % (SELECT count(*) FROM part)""",
    ),
    "topic_vectors": (
        (),
        f"""SELECT t.topic_no, t.topic, list(c.value ORDER BY c.dim) AS vector
FROM (SELECT label, dim, avg(CAST(embedding[dim] AS DOUBLE)) AS value
      FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings)
      GROUP BY label, dim) c
JOIN ({TOPIC_ROWS}) t(topic_no, topic) ON t.topic_no = c.label
GROUP BY t.topic_no, t.topic""",
    ),
    "cleaned_docs": (
        ("review_docs",),
        f"""SELECT review_id, {CLEAN.format('review_text')} AS clean_review_text FROM review_docs""",
    ),
    "lexicon": ((), f"SELECT token, CAST(valence AS DOUBLE) AS valence FROM ({values(LEXICON)}) l(token, valence)"),
    "plain_sentiment": (
        ("cleaned_docs", "lexicon"),
        """SELECT review_id, round_even(total / sqrt(total * total + 15.0), 4) AS sentiment_score
FROM (SELECT w.review_id, CAST(sum(CAST(l.valence AS DECIMAL(12,6))) AS DOUBLE) AS total
      FROM (SELECT review_id, unnest(string_split(clean_review_text, ' ')) AS token FROM cleaned_docs) w
      JOIN lexicon l USING (token) GROUP BY w.review_id)""",
    ),
    "mods": (
        ("lexicon",),
        f"SELECT * FROM ({values([(w, b, int(n)) for w, b, n in RULE_MODIFIERS])}) m(word, boost, negates) WHERE word NOT IN (SELECT token FROM lexicon)",
    ),
    "rule_words": (
        ("cleaned_docs",),
        """SELECT review_id, list_transform(list_filter(string_split(clean_review_text, ' '), lambda w: length(w) > 1),
  lambda w: regexp_replace(w, '^''([a-z0-9]{2,})$|^([a-z0-9]{2,})''$', '\\1\\2')) AS ws FROM cleaned_docs WHERE clean_review_text <> ''""",
    ),
    "sentiment": (
        ("rule_words", "lexicon", "mods"),
        f"""SELECT review_id, round_even(total / sqrt(total * total + 15.0), 4) AS sentiment_score FROM (
  SELECT review_id, CAST(sum(CASE WHEN silent THEN 0 ELSE CAST(v3 AS DECIMAL(20,10)) END * weight) AS DOUBLE) AS total FROM (
    SELECT *, v3raw * CASE WHEN g3 THEN CAST(-0.74 AS DOUBLE) ELSE 1.0 END AS v3 FROM (
     SELECT *, v2 + CASE WHEN v2 < 0 THEN -(s3 * CAST(0.9 AS DOUBLE)) ELSE s3 * CAST(0.9 AS DOUBLE) END AS v3raw FROM (
      SELECT *, v2raw * CASE WHEN g2 THEN CAST(-0.74 AS DOUBLE) ELSE 1.0 END AS v2 FROM (
       SELECT *, v1 + CASE WHEN v1 < 0 THEN -(s2 * CAST(0.95 AS DOUBLE)) ELSE s2 * CAST(0.95 AS DOUBLE) END AS v2raw FROM (
        SELECT *, v1raw * CASE WHEN g1 THEN CAST(-0.74 AS DOUBLE) ELSE 1.0 END AS v1 FROM (
         SELECT f.review_id, f.token, f.weight,
           f.token IN ({', '.join(repr(w) for w, b, _ in RULE_MODIFIERS if b)}) OR (f.token = 'kind' AND coalesce(f.a1 = 'of', FALSE)) AS silent,
           f.valence + CASE WHEN f.valence < 0 THEN -coalesce(m1.boost, 0.0) ELSE coalesce(m1.boost, 0.0) END AS v1raw,
           coalesce(m2.boost, 0.0) AS s2, coalesce(m3.boost, 0.0) AS s3,
           coalesce(m1.negates = 1, FALSE) OR coalesce(contains(f.b1, 'n''t'), FALSE) AS g1,
           coalesce(m2.negates = 1, FALSE) OR coalesce(contains(f.b2, 'n''t'), FALSE) AS g2,
           coalesce(m3.negates = 1, FALSE) OR coalesce(contains(f.b3, 'n''t'), FALSE) AS g3
         FROM (SELECT g.*, CASE WHEN spot > 1 THEN ws[spot - 1] END AS b1, CASE WHEN spot > 2 THEN ws[spot - 2] END AS b2,
                 CASE WHEN spot > 3 THEN ws[spot - 3] END AS b3, CASE WHEN spot < len(ws) THEN ws[spot + 1] END AS a1
               FROM (SELECT u.review_id, u.token, any_value(l.valence) AS valence, min(pos) AS spot,
                       sum(CASE WHEN turn = 0 OR pos = turn THEN 1.0 WHEN pos < turn THEN 0.5 ELSE 1.5 END) AS weight
                     FROM (SELECT review_id, coalesce(list_position(ws, '{RULE_CONTRAST}'), 0) AS turn, unnest(ws) AS token, unnest(range(1, len(ws) + 1)) AS pos
                           FROM rule_words) u JOIN lexicon l USING (token) GROUP BY u.review_id, u.token) g
               JOIN rule_words USING (review_id)) f
         LEFT JOIN mods m1 ON m1.word = f.b1 LEFT JOIN mods m2 ON m2.word = f.b2 LEFT JOIN mods m3 ON m3.word = f.b3)))))) GROUP BY review_id)""",
    ),
    "text_words": (
        (),
        f"""SELECT token, CAST(CAST(length(token) % 5 - 2 AS DECIMAL(4,1)) * CAST(0.9 AS DECIMAL(2,1)) AS DOUBLE) AS valence
FROM (SELECT DISTINCT unnest(string_split(c, ' ')) AS token
      FROM (SELECT {CLEAN.format('text')} AS c FROM documents) WHERE c <> '')
WHERE token NOT IN ({', '.join(repr(w) for w, _, _ in RULE_MODIFIERS)})""",
    ),
    "listed_mods": ((), f"SELECT * FROM ({values([(w, b, int(n)) for w, b, n in RULE_MODIFIERS])}) m(word, boost, negates)"),
    "whole_sentiment": (
        ("rule_words", "text_words", "listed_mods"),
        f"""SELECT review_id, round_even(total / sqrt(total * total + 15.0), 4) AS sentiment_score FROM (
  SELECT review_id, CAST(sum(CASE WHEN silent THEN 0 ELSE CAST(v3 AS DECIMAL(20,10)) END * weight) AS DOUBLE) AS total FROM (
    SELECT *, v3raw * CASE WHEN g3 THEN CAST(-0.74 AS DOUBLE) ELSE 1.0 END AS v3 FROM (
     SELECT *, v2 + CASE WHEN v2 < 0 THEN -(s3 * CAST(0.9 AS DOUBLE)) ELSE s3 * CAST(0.9 AS DOUBLE) END AS v3raw FROM (
      SELECT *, v2raw * CASE WHEN g2 THEN CAST(-0.74 AS DOUBLE) ELSE 1.0 END AS v2 FROM (
       SELECT *, v1 + CASE WHEN v1 < 0 THEN -(s2 * CAST(0.95 AS DOUBLE)) ELSE s2 * CAST(0.95 AS DOUBLE) END AS v2raw FROM (
        SELECT *, v1raw * CASE WHEN g1 THEN CAST(-0.74 AS DOUBLE) ELSE 1.0 END AS v1 FROM (
         SELECT f.review_id, f.token, f.weight,
           f.token IN ({', '.join(repr(w) for w, b, _ in RULE_MODIFIERS if b)}) OR (f.token = 'kind' AND coalesce(f.a1 = 'of', FALSE)) AS silent,
           l.valence + CASE WHEN l.valence < 0 THEN -coalesce(m1.boost, 0.0) ELSE coalesce(m1.boost, 0.0) END AS v1raw,
           coalesce(m2.boost, 0.0) AS s2, coalesce(m3.boost, 0.0) AS s3,
           coalesce(m1.negates = 1, FALSE) OR coalesce(contains(f.b1, 'n''t'), FALSE) AS g1,
           coalesce(m2.negates = 1, FALSE) OR coalesce(contains(f.b2, 'n''t'), FALSE) AS g2,
           coalesce(m3.negates = 1, FALSE) OR coalesce(contains(f.b3, 'n''t'), FALSE) AS g3
         FROM (SELECT review_id, token, sum(CASE WHEN turn = 0 OR pos = turn THEN 1.0 WHEN pos < turn THEN 0.5 ELSE 1.5 END) AS weight,
                 unnest(min_by({{'b1': b1, 'b2': b2, 'b3': b3, 'a1': a1}}, pos))
               FROM (SELECT review_id, pos, turn, ws[pos] AS token, CASE WHEN pos > 1 THEN ws[pos - 1] END AS b1,
                       CASE WHEN pos > 2 THEN ws[pos - 2] END AS b2, CASE WHEN pos > 3 THEN ws[pos - 3] END AS b3,
                       CASE WHEN pos < len(ws) THEN ws[pos + 1] END AS a1
                     FROM (SELECT review_id, ws, coalesce(list_position(ws, '{RULE_CONTRAST}'), 0) AS turn, unnest(range(1, len(ws) + 1)) AS pos
                           FROM rule_words))
               GROUP BY review_id, token) f
         JOIN text_words l USING (token)
         LEFT JOIN listed_mods m1 ON m1.word = f.b1 LEFT JOIN listed_mods m2 ON m2.word = f.b2 LEFT JOIN listed_mods m3 ON m3.word = f.b3))))))
  GROUP BY review_id)""",
    ),
    "ranked_topics": (
        ("review_docs", "topic_vectors", "cleaned_docs"),
        """SELECT review_id, topic, score,
  row_number() OVER (PARTITION BY review_id ORDER BY score DESC, topic_no) AS place
FROM (SELECT r.review_id, t.topic_no, t.topic,
        round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), t.vector), 4) AS score
      FROM review_docs r JOIN embeddings e USING (vec_id)
      JOIN cleaned_docs c ON c.review_id = r.review_id AND c.clean_review_text <> ''
      CROSS JOIN topic_vectors t)
WHERE score >= 0.10""",
    ),
    "topic_rows": (
        ("ranked_topics", "review_docs"),
        """SELECT review_id, topic, score, place FROM ranked_topics WHERE place <= 3
UNION ALL
SELECT review_id, 'Other', 0.0, 1 FROM review_docs WHERE review_id NOT IN (SELECT review_id FROM ranked_topics)""",
    ),
    "enriched": (
        ("review_docs", "cleaned_docs", "sentiment", "topic_rows"),
        f"""SELECT r.review_id, r.review_date, {MONTH.format('r.review_date')} AS review_month, r.review_score,
  {STANDARD.format('r.category')} AS category, r.review_text, c.clean_review_text,
  coalesce(s.sentiment_score, 0.0) AS sentiment_score,
  CASE WHEN s.sentiment_score > 0.05 THEN 'Positive' WHEN s.sentiment_score < -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label,
  t.primary_topic, t.primary_topic_score, t.topics_text, t.topic_scores_text, CAST(t.topic_count AS INTEGER) AS topic_count
FROM review_docs r JOIN cleaned_docs c USING (review_id) LEFT JOIN sentiment s USING (review_id)
JOIN (SELECT review_id, min_by(topic, place) AS primary_topic, min_by(score, place) AS primary_topic_score,
        string_agg(topic, ', ' ORDER BY place) AS topics_text,
        string_agg(CAST(score AS VARCHAR), ', ' ORDER BY place) AS topic_scores_text, count(*) AS topic_count
      FROM topic_rows GROUP BY review_id) t USING (review_id)""",
    ),
    "review_months": (
        ("enriched",),
        f"""SELECT review_month, category, count(review_text) AS total_reviews,
  round_even(CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS avg_sentiment_score,
  {labels()},
  round_even(avg(review_score), 4) AS avg_review_score, round_even(avg(topic_count), 2) AS avg_topic_count
FROM enriched GROUP BY review_month, category""",
    ),
    "topic_months": (
        ("enriched", "topic_rows"),
        f"""SELECT review_month, category, topic, count(topic) AS topic_review_count,
  round_even(CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS avg_topic_sentiment_score,
  round_even(CAST(sum(CAST(score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS avg_topic_similarity_score,
  {labels(suffix='topic_reviews')}
FROM enriched JOIN topic_rows USING (review_id) GROUP BY review_month, category, topic""",
    ),
    "category_months": (
        ("sales_lines",),
        """SELECT category, sales_month, sum(sales) AS total_sales, count(category) AS total_transactions
FROM sales_lines GROUP BY category, sales_month""",
    ),
    "combined": (
        ("sales_lines", "review_months"),
        """SELECT s.sales_month, s.category, CAST(s.total_sales AS DOUBLE) AS total_sales, s.total_transactions,
  r.review_month, r.total_reviews, r.avg_sentiment_score, r.positive_reviews, r.neutral_reviews,
  r.negative_reviews, r.avg_review_score, r.avg_topic_count,
  round_even((coalesce(r.avg_sentiment_score, 0.0) * CAST(0.7 AS DOUBLE)
    + CAST(coalesce(r.total_reviews, 0) AS DOUBLE) * CAST(0.3 AS DOUBLE)) * 100, 2) AS review_impact_score
FROM (SELECT sales_month, category_key AS category, sum(sales) AS total_sales, count(category) AS total_transactions
      FROM sales_lines GROUP BY sales_month, category_key) s
JOIN review_months r ON s.sales_month = r.review_month AND s.category IS NOT DISTINCT FROM r.category""",
    ),
    "segments": (
        ("combined",),
        f"""SELECT b.*, g.insight_text, g.advice_text FROM (
  SELECT m.*, CASE
      WHEN total_sales IS NULL OR avg_sentiment_score IS NULL THEN 'Insufficient Data'
      WHEN total_sales >= sales_threshold AND avg_sentiment_score >= sentiment_threshold THEN 'Strong Performer'
      WHEN total_sales >= sales_threshold AND avg_sentiment_score < sentiment_threshold THEN 'Risk'
      WHEN total_sales < sales_threshold AND avg_sentiment_score >= sentiment_threshold THEN 'Opportunity'
      ELSE 'Weak' END AS segment
  FROM (SELECT c.*, CAST(year(sales_month) AS INTEGER) AS year, CAST(month(sales_month) AS INTEGER) AS month_number,
          strftime(sales_month, '%b') AS month_name, strftime(sales_month, '%Y-%m') AS year_month,
          CASE WHEN month(sales_month) IN (12, 1, 2) THEN 'Winter' WHEN month(sales_month) IN (3, 4, 5) THEN 'Spring'
               WHEN month(sales_month) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season,
          median(total_sales) OVER (PARTITION BY sales_month) AS sales_threshold,
          median(avg_sentiment_score) OVER (PARTITION BY sales_month) AS sentiment_threshold
        FROM combined c) m) b
JOIN ({values([(k, *v) for k, v in lookups.SEGMENT_TEXT.items()])}) g(name, insight_text, advice_text) ON g.name = b.segment""",
    ),
    "advice": (
        ("segments",),
        """SELECT s.*,
  replace(replace(replace(insight_text, '{month}', year_month), '{category}', category), '{season}', season) AS insight,
  replace(replace(replace(advice_text, '{month}', year_month), '{category}', category), '{season}', season) AS recommendation
FROM segments s""",
    ),
    "sales_review_summary": (
        ("sales_lines", "review_events"),
        """SELECT s.category, CAST(s.total_sales AS DOUBLE) AS total_sales, s.total_transactions,
  coalesce(r.total_reviews, 0) AS total_reviews, coalesce(r.avg_review_score, 0.0) AS avg_review_score
FROM (SELECT category, sum(sales) AS total_sales, count(order_id) AS total_transactions FROM sales_lines GROUP BY category) s
LEFT JOIN (SELECT category, count(*) AS total_reviews, avg(review_score) AS avg_review_score
           FROM review_events GROUP BY category) r ON s.category = r.category""",
    ),
    "rating_months": (
        ("review_events",),
        f"""SELECT {MONTH.format('review_date')} AS review_month, category, count(*) AS total_reviews,
  avg(review_score) AS avg_review_score, {buckets('review_score')}
FROM review_events WHERE review_date IS NOT NULL GROUP BY 1, 2""",
    ),
    "rating_products": (
        ("review_events",),
        f"""SELECT {MONTH.format('review_date')} AS review_month, product_id, product_name, category,
  count(*) AS total_reviews, avg(review_score) AS avg_review_score, {buckets('review_score')}
FROM review_events WHERE review_date IS NOT NULL GROUP BY 1, 2, 3, 4""",
    ),
    "sales_forecast": (
        ("category_months",),
        f"""SELECT category, {STANDARD.format('category')} AS category_key,
  CAST(sales_month + INTERVAL 12 MONTH AS DATE) AS sales_month,
  round(CAST(total_sales AS DECIMAL(28,4)) * CAST(1.05 AS DECIMAL(4,2)), 2) AS sales
FROM category_months
WHERE sales_month > (SELECT max(sales_month) - INTERVAL 12 MONTH FROM category_months)""",
    ),
    "order_months": (
        ("sales_lines",),
        """SELECT category, sales_month, count(DISTINCT order_id) AS transactions
FROM sales_lines GROUP BY category, sales_month""",
    ),
    "products_forecast": (
        ("order_months",),
        f"""SELECT category, {STANDARD.format('category')} AS category_key,
  CAST(sales_month + INTERVAL 12 MONTH AS DATE) AS sales_month,
  round(CAST(transactions AS DECIMAL(28,4)) * CAST(1.05 AS DECIMAL(4,2)), 2) AS forecast_transactions
FROM order_months
WHERE sales_month > (SELECT max(sales_month) - INTERVAL 12 MONTH FROM order_months)""",
    ),
    "both_tables": (
        ("sales_forecast", "products_forecast"),
        """SELECT * FROM (SELECT category, sales_month FROM sales_forecast UNION SELECT category, sales_month FROM products_forecast)
WHERE year(sales_month) = (SELECT max(y) FROM (SELECT max(year(sales_month)) AS y FROM sales_forecast
                           UNION SELECT max(year(sales_month)) FROM products_forecast))""",
    ),
}


# The way from sentiment to advice once more, with a valence for every word of the texts.
_WHOLE = ("sentiment", "enriched", "review_months", "combined", "segments", "advice")
for _name in _WHOLE[1:]:
    _needs, _body = VIEWS[_name]
    VIEWS[f"whole_{_name}"] = (
        tuple(f"whole_{n}" if n in _WHOLE else n for n in _needs),
        re.sub(rf"\b(FROM|JOIN) ({'|'.join(_WHOLE)})\b", r"\1 whole_\2", _body),
    )


def with_views(names: tuple[str, ...], body: str) -> str:
    """Prefix a query with the views it reads, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    # Texts are cleaned and cut into words once, however often a query names them.
    once = {"cleaned_docs", "rule_words", "sentiment", "plain_sentiment", "whole_sentiment"}
    listed = ",\n".join(f"{name} AS {'MATERIALIZED ' * (name in once)}(\n{VIEWS[name][1]}\n)" for name in ordered)
    return f"WITH {listed}\n{body}"
