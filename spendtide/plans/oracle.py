"""The registered queries in ANSI-style SQL, as DuckDB runs it on the same tables.

Written on its own from the definitions, to be compared with the Spark results.
"""

# ---- shared table expressions ---------------------------------------------------------

JOINED = """
  lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey"""

CREATIVES = f"""creatives AS (
  SELECT l_orderkey || '-' || l_linenumber AS source_id,
    CASE l_returnflag WHEN 'N' THEN 'meta' WHEN 'A' THEN 'google' WHEN 'R' THEN 'synthetic' END AS source,
    lower(c_mktsegment) AS brand, c_mktsegment AS brand_display, p_name AS ad_text,
    CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS cta,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'social' WHEN '2-HIGH' THEN 'search' WHEN '3-MEDIUM' THEN 'video'
      WHEN '4-NOT SPECIFIED' THEN 'display' WHEN '5-LOW' THEN 'ctv' END AS channel,
    p_brand AS platform,
    CAST(l_quantity * 1000 AS BIGINT) AS impression_lower,
    CAST(l_quantity * 1000 AS BIGINT) + p_size * 100 AS impression_upper,
    CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS spend_lower,
    CAST(l_extendedprice AS DECIMAL(18,4)) AS spend_upper,
    CAST(o_orderdate AS DATE) AS started_running,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS stopped_running,
    l_linestatus = 'O' AS is_active, 'USD' AS currency, r_name AS region,
    string_split(p_name, ' ') AS creative_themes, l_shipdate AS ingested_at,
    strftime(o_orderdate, '%G-W%V') AS week_key
  FROM {JOINED})"""

SUMS = """
    count(*) AS ad_count, count(*) FILTER (WHERE is_active) AS active_ad_count,
    CAST(sum(impression_lower) AS BIGINT) AS impression_lower_sum,
    CAST(sum(impression_upper) AS BIGINT) AS impression_upper_sum,
    sum(spend_lower) AS sl, sum(spend_upper) AS su"""


def facts(source: str = "creatives", name: str = "facts") -> str:
    return f"""{name} AS (
  SELECT brand, week_key, channel, region, ad_count, active_ad_count, impression_lower_sum, impression_upper_sum,
    CAST(sl AS DOUBLE) AS spend_lower_sum, CAST(su AS DOUBLE) AS spend_upper_sum,
    CAST(sl + su AS DOUBLE) / 2 AS spend_midpoint,
    CASE WHEN sum(sl + su) OVER w = 0 THEN 0 ELSE CAST(sl + su AS DOUBLE) / CAST(sum(sl + su) OVER w AS DOUBLE) END AS channel_share
  FROM (SELECT brand, week_key, channel, region, {SUMS} FROM {source} GROUP BY ALL)
  WINDOW w AS (PARTITION BY brand, week_key))"""


def tops(source: str = "creatives") -> str:
    return f"""
theme_counts AS (
  SELECT brand, week_key, channel, region, theme, count(*) AS n_ads,
    row_number() OVER (PARTITION BY brand, week_key, channel, region ORDER BY count(*) DESC, theme) AS rank
  FROM (SELECT brand, week_key, channel, region, unnest(creative_themes) AS theme FROM {source})
  GROUP BY brand, week_key, channel, region, theme),
cta_counts AS (
  SELECT brand, week_key, channel, region, cta, count(*) AS n_ads,
    row_number() OVER (PARTITION BY brand, week_key, channel, region ORDER BY count(*) DESC, cta) AS rank
  FROM {source} WHERE cta IS NOT NULL AND cta <> 'unknown'
  GROUP BY brand, week_key, channel, region, cta),
themes AS (
  SELECT brand, week_key, channel, region, list(theme ORDER BY rank) AS top_themes
  FROM theme_counts WHERE rank <= 5 GROUP BY ALL),
ctas AS (
  SELECT brand, week_key, channel, region, list(cta ORDER BY rank) AS top_ctas
  FROM cta_counts WHERE rank <= 3 GROUP BY ALL),
full_facts AS (
  SELECT f.*, coalesce(top_ctas, []) AS top_ctas, coalesce(top_themes, []) AS top_themes
  FROM facts f LEFT JOIN ctas USING (brand, week_key, channel, region)
  LEFT JOIN themes USING (brand, week_key, channel, region))"""


FACTS = f"{CREATIVES}, {facts()}"
FULL = f"{FACTS}, {tops()}"
ORDER = """ingested_at NULLS LAST, brand NULLS LAST, brand_display NULLS LAST, ad_text NULLS LAST, cta NULLS LAST,
    channel NULLS LAST, platform NULLS LAST, impression_lower NULLS LAST, impression_upper NULLS LAST,
    spend_lower NULLS LAST, spend_upper NULLS LAST, started_running NULLS LAST, stopped_running NULLS LAST,
    is_active NULLS LAST, currency NULLS LAST, region NULLS LAST, creative_themes NULLS LAST, week_key NULLS LAST"""
FIRST = f"""first_docs AS (
  SELECT * FROM creatives
  QUALIFY row_number() OVER (PARTITION BY source_id, source ORDER BY {ORDER}) = 1)"""
# Loaded in two runs, old weeks first: the first document of an old week wins over any of a later one.
FIRST_BY_LOAD = f"""first_docs AS (
  SELECT * FROM creatives
  QUALIFY row_number() OVER (PARTITION BY source_id, source ORDER BY week_key >= '1998-W01', {ORDER}) = 1)"""
OLD_KEYS = "SELECT source_id, source FROM creatives WHERE week_key < '1998-W01'"
NEW = f"""added AS (
  SELECT f.* FROM first_docs f ANTI JOIN ({OLD_KEYS}) o ON f.source_id = o.source_id AND f.source = o.source)"""

SHOWN = """source_id, source, brand, brand_display, ad_text, cta, channel, platform, impression_lower, impression_upper,
  CAST(spend_lower AS DOUBLE) AS spend_lower, CAST(spend_upper AS DOUBLE) AS spend_upper,
  strftime(started_running, '%Y-%m-%d') AS started_running, strftime(stopped_running, '%Y-%m-%d') AS stopped_running,
  is_active, currency, region, array_to_string(creative_themes, '|') AS creative_themes,
  strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at, week_key"""
FACT_COLS = """brand, week_key, channel, region, {ad_count}, active_ad_count, impression_lower_sum, impression_upper_sum,
  spend_lower_sum, spend_upper_sum, spend_midpoint, round(channel_share, 6) AS channel_share"""
FACT = FACT_COLS.format(ad_count="ad_count")

SPEND = "CAST(sum(CAST(spend_midpoint AS DECIMAL(20,5))) AS DOUBLE)"

SERIES = """series AS (
  SELECT brand, channel, week_key, sum(CAST(spend_midpoint AS DECIMAL(20,5))) AS spend,
    row_number() OVER (PARTITION BY brand, channel ORDER BY week_key DESC) AS rn
  FROM facts GROUP BY brand, channel, week_key),
shape AS (
  SELECT brand, channel, count(*) AS n_weeks,
    CAST(arg_min(spend, week_key) AS DOUBLE) AS first_y, CAST(arg_max(spend, week_key) AS DOUBLE) AS last_y,
    CAST(sum(spend) FILTER (WHERE rn <= 4) AS DOUBLE) AS recent,
    CAST(sum(spend) FILTER (WHERE rn BETWEEN 5 AND 8) AS DOUBLE) AS prior
  FROM series GROUP BY brand, channel),
ends AS (SELECT *, CASE WHEN n_weeks < 4 THEN 0 ELSE (last_y - first_y) / (first_y + 1e-9) * 100 END AS pct FROM shape),
halves AS (
  SELECT *, CASE WHEN n_weeks >= 8 THEN (recent - prior) / (prior + 1e-9) * 100
    WHEN n_weeks >= 4 THEN (last_y - first_y) / (first_y + 1e-9) * 100 ELSE 0 END AS pct FROM shape)"""
DIRECTION = "CASE WHEN pct > 10 THEN 'increasing' WHEN pct < -10 THEN 'decreasing' ELSE 'flat' END"

FEATURES = f"""features AS (
  SELECT brand, week_key, {SPEND} AS spend_midpoint,
    CAST(sum(active_ad_count) AS BIGINT) AS active_ad_count,
    CAST(sum(impression_upper_sum) AS BIGINT) AS impression_upper_sum, avg(channel_share) AS channel_share
  FROM facts GROUP BY brand, week_key)"""


def _z(c: str) -> str:
    std = f"stddev_pop({c}) OVER w"
    return f"pow(({c} - avg({c}) OVER w) / CASE WHEN {std} = 0 THEN 1 ELSE {std} END, 2)"


FLAGS = f"""scored AS (
  SELECT brand, week_key, count(*) OVER w AS n_weeks,
    {' + '.join(_z(c) for c in ('spend_midpoint', 'channel_share', 'active_ad_count', 'impression_upper_sum'))} AS score
  FROM features WINDOW w AS (PARTITION BY brand)),
flags AS (
  SELECT brand, week_key, n_weeks, CASE WHEN n_weeks >= 8 THEN round(score, 4) END AS score,
    n_weeks >= 8 AND score > quantile_cont(score, 0.85) OVER (PARTITION BY brand) AS is_anomaly
  FROM scored)"""


def mix(of: str = "facts") -> str:
    return f"""mix AS (
  SELECT brand, channel, CAST(s AS DOUBLE) AS spend,
    round(CAST(s AS DOUBLE) / CASE WHEN sum(s) OVER (PARTITION BY brand) = 0 THEN 1
      ELSE CAST(sum(s) OVER (PARTITION BY brand) AS DOUBLE) END * 100, 1) AS pct
  FROM (SELECT brand, channel, sum(CAST(spend_midpoint AS DECIMAL(20,5))) AS s FROM (
      SELECT *, dense_rank() OVER (PARTITION BY brand ORDER BY week_key DESC) AS wk FROM {of})
    WHERE wk <= 4 GROUP BY brand, channel))"""


def totals(of: str = "facts") -> str:
    return f"""totals AS (
  SELECT brand, week_key, {SPEND} AS spend FROM (
    SELECT *, dense_rank() OVER (PARTITION BY brand ORDER BY week_key DESC) AS wk FROM {of})
  WHERE wk <= 8 GROUP BY brand, week_key)"""


def brand_themes(of: str = "full_facts") -> str:
    return f"""brand_themes AS (
  SELECT brand, theme, count(*) AS n_rows,
    row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, theme) AS rank
  FROM (SELECT brand, unnest(top_themes) AS theme FROM {of}) GROUP BY brand, theme
  QUALIFY rank <= 5)"""


def dominant(of: str) -> str:
    return f"""dominant AS (
  SELECT brand, d AS dominant_trend, n AS n_channels FROM (
    SELECT brand, d, count(*) AS n, min(channel) AS c FROM (SELECT brand, channel, {DIRECTION} AS d FROM {of}) GROUP BY brand, d)
  QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, c) = 1)"""


INVISIBLE = (
    r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}"
    r"\x{E0100}-\x{E01EF}\x{E0000}-\x{E007F}\x{180E}\x{115F}\x{1160}\x{2061}-\x{2064}\x{3164}]"
)
SMUGGLED = """smuggled AS (
  SELECT doc_id, replace(replace(text, ', ', ',' || chr(8203) || ' '), '. ', '.' || chr(917601) || ' ') AS text FROM documents)"""
HITS = f"""chars AS (
  SELECT doc_id, line, generate_subscripts(string_split(txt, ''), 1) AS col, unnest(string_split(txt, '')) AS ch FROM (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS txt
    FROM smuggled)),
hits AS (
  SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, printf('U+%04X', unicode(ch)) AS code_point
  FROM chars WHERE regexp_matches(ch, '{INVISIBLE}'))"""

ADS = """ads AS (
  SELECT l_orderkey || '-' || l_linenumber AS id,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' co-op' AS term, c_name || ' offer' AS ad_text,
    CAST((l_linenumber - 1) * 3 AS BIGINT) AS page_index,
    CASE WHEN l_partkey % 7 <> 0 AND l_partkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) ELSE DATE '2001-01-01' END AS started,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS stopped,
    CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_quantity * 1000 AS BIGINT) ELSE 0 END AS impression_lower,
    CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_quantity * 1000 AS BIGINT) + 500 ELSE 0 END AS impression_upper,
    CASE WHEN l_partkey % 17 <> 0 THEN l_quantity ELSE 0.0 END AS spend_lower,
    CASE WHEN l_partkey % 17 <> 0 THEN l_quantity * 2 ELSE 0.0 END AS spend_upper,
    CASE WHEN l_partkey % 17 <> 0 AND l_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
    CASE l_partkey % 5 WHEN 1 THEN 'instagram' WHEN 2 THEN 'audience_network' WHEN 3 THEN 'video' ELSE 'facebook' END AS platform,
    CASE l_partkey % 5 WHEN 2 THEN 'display' WHEN 3 THEN 'video' ELSE 'social' END AS channel,
    CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 END AS n_platforms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

LINEAR = "greatest(0, last_y + (last_y - first_y) / greatest(n_weeks - 1, 1) * step)"
STEPS = "(SELECT unnest([1, 2, 3, 4]) AS step) s"


def summary(of: str = "full_facts", channels: str | None = None) -> str:
    """Parts of the summary over `full_facts`, or over a channel list of it."""
    out = f"{FULL}, "
    if channels:
        out += f"picked AS (SELECT * FROM full_facts WHERE channel IN ({channels})), "
        of = "picked"
    inner = ", ".join([SERIES, FEATURES, FLAGS]).replace("FROM facts ", f"FROM {of} ")
    return out + ", ".join([inner, mix(of), totals(of), brand_themes(of), dominant("ends")]) + f""",
seen AS (SELECT brand, count(DISTINCT week_key) AS weeks_analysed FROM {of} GROUP BY brand),
odd AS (SELECT brand, list(week_key ORDER BY week_key) FILTER (WHERE is_anomaly) AS weeks,
  count(*) FILTER (WHERE is_anomaly) AS n_anomalies FROM flags GROUP BY brand),
top AS (SELECT brand, list(theme ORDER BY rank) AS themes FROM brand_themes GROUP BY brand),
mixed AS (SELECT brand, string_agg(channel || ': ' || printf('%.1f', pct) || '%', ', ' ORDER BY pct DESC, channel) AS mix FROM mix GROUP BY brand),
trends AS (SELECT brand, string_agg(channel || ': ' || {DIRECTION} || ' (' || printf('%+.1f', round(pct, 2)) || '%)', ' | ' ORDER BY channel) AS trends
  FROM ends GROUP BY brand)"""


PARTS = """seen LEFT JOIN dominant USING (brand) LEFT JOIN odd USING (brand) LEFT JOIN top USING (brand)
  LEFT JOIN mixed USING (brand) LEFT JOIN trends USING (brand)"""

NOBODY = "UNION ALL SELECT 'nobody', 'no_data', NULL, NULL, NULL, NULL, NULL"

CONTEXT = """'SIGNAL DATA (' || weeks_analysed || ' weeks of observations):' || chr(10)
  || '* direction: ' || dominant_trend || chr(10)
  || '* Channel mix, last weeks: ' || mix || chr(10)
  || '* by channel: ' || trends || chr(10)
  || '* unusual weeks: ' || CASE WHEN n_anomalies = 0 THEN 'none detected'
       ELSE array_to_string(list_slice(weeks, greatest(len(weeks) - 2, 1), len(weeks)), ', ') END || chr(10)
  || '* themes: ' || coalesce(array_to_string(themes, ', '), 'not enough rows')"""
BRIEF = """CASE WHEN brand = 'machinery' THEN '[LLM Error: refused]'
  ELSE 'Brief: On ' || upper(brand) || ', in brief.' END"""

# Arrivals in numbered batches: `before` is the newest time of all earlier batches, `older` that of all but the last of them.
RESENT = """ev AS (
  SELECT event_id, ts, (extract(day FROM ts) - 1) // 5 AS slot, CASE event_id % 10 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS lag FROM events),
sent AS (
  SELECT event_id, ts, 1 AS time, slot + lag AS batch FROM ev UNION ALL
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 20 DAYS ELSE ts END, 2, CASE WHEN event_id % 3 = 0 THEN slot + 4 ELSE slot + lag + 1 END FROM ev),
marks AS (
  SELECT batch, date_trunc('millisecond', max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) - INTERVAL 6 DAYS AS older
  FROM (SELECT batch, max(ts) AS newest FROM sent GROUP BY batch)),
passing AS (SELECT s.*, older FROM sent s JOIN marks USING (batch) WHERE older IS NULL OR ts > older)"""

LATE = f"""{CREATIVES},
sent AS (
  SELECT *, CAST(date_trunc('week', started_running) AS DATE) AS monday,
    (CAST(started_running - DATE '1992-01-01' AS BIGINT)) // 800
      + CASE CAST(split_part(source_id, '-', 1) AS BIGINT) % 10 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS batch FROM creatives),
marks AS (
  SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 300 AS before,
    max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 300 AS older,
    max(newest) OVER () - 300 AS after
  FROM (SELECT batch, max(started_running) AS newest FROM sent GROUP BY batch))"""
WINDOW_SUMS = """strftime(monday, '%Y-%m-%d') AS monday, strftime(monday, '%G-W%V') AS week_key, count(*) AS ad_count,
  count(*) FILTER (WHERE is_active) AS active_ad_count, CAST(sum(impression_lower) AS BIGINT) AS impression_lower_sum,
  CAST(sum(impression_upper) AS BIGINT) AS impression_upper_sum, CAST(sum(spend_lower) AS DOUBLE) AS spend_lower_sum,
  CAST(sum(spend_upper) AS DOUBLE) AS spend_upper_sum, CAST(sum(spend_lower) + sum(spend_upper) AS DOUBLE) / 2 AS spend_midpoint"""

# Pages of orders in walks of a segment and nation, followed by a recursion; a page that leads back is met at most
# as often as there are pages.
WALKS = """keyed AS (
  SELECT lower(c_mktsegment) || '/' || c_nationkey AS brand, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey),
pages AS (
  SELECT brand, k, CASE WHEN lag(k) OVER w IS NOT NULL THEN 'c' || k END AS cursor,
    CASE WHEN k % 997 = 0 THEN 'lost-' || k WHEN k % 1499 = 0 THEN 'c' || lag(k, 3) OVER w ELSE 'c' || lead(k) OVER w END AS next,
    count(*) OVER (PARTITION BY brand) AS n
  FROM keyed WINDOW w AS (PARTITION BY brand ORDER BY k)),
steps AS (
  SELECT brand, k, next, n, 0 AS at FROM pages WHERE cursor IS NULL
  UNION ALL
  SELECT p.brand, p.k, p.next, p.n, s.at + 1 FROM steps s JOIN pages p ON p.brand = s.brand AND p.cursor = s.next WHERE s.at < s.n),
placed AS (SELECT brand, k, min(steps.at) AS page_index FROM steps GROUP BY brand, k)"""

SNAP_1 = "(SELECT * FROM facts WHERE week_key < '1998-W01')"


# ---- one text per query ---------------------------------------------------------------

SQL: dict[str, str] = {
    "load_creatives": f"""WITH {CREATIVES} SELECT * REPLACE (CAST(NULL AS VARCHAR) AS brand_display, CAST(NULL AS VARCHAR) AS currency)
FROM (SELECT {SHOWN} FROM creatives)""",
    "scan_all": f"WITH {CREATIVES} SELECT {SHOWN} FROM creatives",
    "brand_recent_creatives": f"""WITH {CREATIVES} SELECT {SHOWN}, place FROM (
SELECT *, row_number() OVER (ORDER BY ingested_at DESC, source_id, source, {ORDER.replace('NULLS LAST', 'NULLS FIRST').split(',', 1)[1]}) AS place
FROM creatives WHERE brand = 'building' ORDER BY ingested_at DESC, source_id, source, {ORDER.replace('NULLS LAST', 'NULLS FIRST').split(',', 1)[1]} LIMIT 1000)""",
    "normalise_ads": f"""WITH {ADS} SELECT id AS source_id, 'meta' AS source, replace(lower(term), ' ', '-') AS brand,
  replace(term, 'co-op', 'Co-Op') AS brand_display, ad_text, 'Learn More' AS cta, channel, platform,
  impression_lower, impression_upper, CAST(spend_lower AS DOUBLE) AS spend_lower, CAST(spend_upper AS DOUBLE) AS spend_upper,
  strftime(started, '%Y-%m-%d') AS started_running, strftime(stopped, '%Y-%m-%d') AS stopped_running,
  stopped IS NULL AS is_active, currency, 'US' AS region, '' AS creative_themes,
  '2001-01-01 00:00:00' AS ingested_at, strftime(started, '%G-W%V') AS week_key FROM ads""",
    "explode_ad_pages": f"""WITH {ADS} SELECT term AS brand, page_index, id,
  CAST(n_platforms AS BIGINT) AS n_platforms FROM ads, (SELECT unnest([1, 2])) copies""",
    "explode_first_pages": f"""WITH {ADS} SELECT term AS brand, page_index, id,
  CAST(n_platforms AS BIGINT) AS n_platforms FROM ads, (SELECT unnest([1, 2])) copies WHERE page_index < 16""",
    "read_pages": f"""WITH {ADS} SELECT term AS brand, page_index, id,
  CAST(n_platforms AS BIGINT) AS n_platforms FROM ads, (SELECT unnest([1, 2])) copies""",
    "walk_pages": f"""WITH RECURSIVE {WALKS}
SELECT brand, cursor, CASE WHEN copy = 1 THEN page_index END AS page_index,
  CASE WHEN copy = 2 THEN 'copy' WHEN page_index IS NULL THEN 'unreached' ELSE 'walked' END AS state,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = p.k) AS n_ads
FROM pages p LEFT JOIN placed USING (brand, k), (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR k % 251 = 0""",
    "walk_report": f"""WITH RECURSIVE {WALKS}, ends AS (SELECT brand, count(*) AS n_walked FROM placed GROUP BY brand)
SELECT brand AS walk, (SELECT count(*) + count(*) FILTER (WHERE k % 251 = 0) FROM pages p WHERE p.brand = e.brand) AS n_pages, n_walked,
  CASE WHEN next IS NULL THEN 'end' WHEN next LIKE 'lost-%' THEN 'gap' ELSE 'cycle' END AS ended,
  CASE WHEN next LIKE 'lost-%' THEN next END AS missing
FROM (SELECT brand, n_walked, (SELECT next FROM placed JOIN pages USING (brand, k) WHERE brand = g.brand ORDER BY page_index DESC LIMIT 1) AS next
  FROM ends g) e""",
    "explode_walked_pages": f"""WITH RECURSIVE {WALKS}
SELECT brand, page_index, l_orderkey || '-' || l_linenumber AS id FROM placed JOIN lineitem ON l_orderkey = k WHERE page_index < 16""",
    "relabel_search_source": f"""WITH {CREATIVES} SELECT source_id,
  CASE WHEN channel IN ('search', 'video', 'display') THEN 'google' ELSE source END AS source, channel,
  CASE WHEN channel IN ('search', 'video', 'display') THEN
    CASE CAST('0x' || substr(md5(source_id), 1, 8) AS UBIGINT) % 3
      WHEN 0 THEN 'google_search' WHEN 1 THEN 'youtube' ELSE 'google_display' END
  ELSE platform END AS platform, week_key FROM creatives""",
    "insert_only_rerun": f"""WITH {CREATIVES} SELECT source, count(DISTINCT source_id) AS stored FROM creatives
WHERE impression_lower % 9000 <> 0 GROUP BY source""",
    "load_rejects": f"""WITH {CREATIVES} SELECT CASE WHEN impression_lower % 9000 = 0 THEN 'key' ELSE 'week' END AS reason, count(*) AS n
FROM creatives WHERE impression_lower % 9000 = 0 OR impression_lower % 25000 = 0 GROUP BY reason""",
    "week_key_derived": f"""WITH {CREATIVES} SELECT CASE WHEN impression_lower % 9000 <> 0 THEN source_id END AS source_id, source,
  impression_lower, CASE WHEN impression_lower % 25000 <> 0 THEN week_key END AS week_key,
  CASE WHEN impression_lower % 11000 = 0 THEN 0 ELSE CAST(spend_upper AS DOUBLE) END AS spend_upper,
  CAST(spend_lower + CASE WHEN impression_lower % 11000 = 0 THEN 0 ELSE spend_upper END AS DOUBLE) / 2 AS spend_midpoint
FROM creatives""",
    "bad_amounts": f"""WITH {CREATIVES} SELECT CAST(0 AS BIGINT) AS spend_lower, count(*) AS spend_upper FROM creatives
WHERE impression_lower % 11000 = 0""",
    "bad_dates": f"""WITH {CREATIVES} SELECT count(*) AS started_running, CAST(0 AS BIGINT) AS stopped_running, count(*) AS ingested_at
FROM creatives WHERE impression_lower % 7000 = 0""",
    "insert_only_upsert": f"WITH {CREATIVES}, {FIRST}, {NEW} SELECT {SHOWN} FROM added",
    "upsert_counts": f"""WITH {CREATIVES}, {FIRST}, {NEW}
SELECT count(*) AS upserted, CAST(0 AS BIGINT) AS modified, CAST(0 AS BIGINT) AS errors FROM added""",
    "upsert_counts_by_brand": f"""WITH {CREATIVES}, {FIRST}, {NEW}
SELECT brand, (SELECT count(*) FROM added a WHERE a.brand = b.brand) AS upserted, CAST(0 AS BIGINT) AS modified,
  CAST(0 AS BIGINT) AS errors FROM (SELECT DISTINCT brand FROM creatives) b""",
    "new_docs_since": "SELECT count(*) AS new_docs FROM events",
    "append_raw": f"WITH {CREATIVES} SELECT {SHOWN} FROM creatives",
    "overwrite_partitions": f"""WITH {FACTS} SELECT {FACT_COLS.format(
        ad_count="CASE WHEN week_key BETWEEN '1998-W10' AND '1998-W20' THEN ad_count + 1000 ELSE ad_count END AS ad_count")} FROM facts""",
    "overwrite_or_append": f"""WITH {FACTS} SELECT brand, week_key, channel, region, ad_count, spend_midpoint
FROM facts, (SELECT unnest([1, 2])) copies""",
    "conform": f"""WITH {FACTS} SELECT {FACT}, CAST(NULL AS VARCHAR) AS top_ctas, CAST(NULL AS VARCHAR) AS top_themes,
  CAST(NULL AS VARCHAR) AS etl_timestamp FROM facts""",
    "create_table": f"""WITH {FACTS} SELECT brand, substr(week_key, 1, 4) AS yr, count(*) AS n, CAST(sum(ad_count) AS BIGINT) AS ads
FROM facts GROUP BY ALL""",
    "list_snapshots": f"""WITH {FACTS} SELECT 'brand_weekly_signals' AS "table", CAST(1 AS BIGINT) AS snapshot_id,
  '978307200000' AS committed_at, 'overwrite' AS operation, count(*) AS added_records, 2 AS place FROM facts WHERE week_key < '1998-W01'
UNION ALL SELECT 'brand_weekly_signals', 2, '978393600000', 'append', count(*), 1 FROM facts WHERE week_key >= '1998-W01'""",
    "read_as_of": f"WITH {FACTS} SELECT {FACT} FROM facts WHERE week_key < '1998-W01'",
    "snapshot_diff": f"""WITH {FACTS}, sums AS (SELECT brand,
    coalesce({SPEND.replace(') AS DOUBLE)', ") FILTER (WHERE week_key < '1998-W01') AS DOUBLE)")}, 0) AS spend_prev, {SPEND} AS spend_cur
  FROM facts GROUP BY brand)
SELECT *, round(spend_cur - spend_prev, 4) AS delta, round((spend_cur - spend_prev) / (spend_prev + 1e-9) * 100, 2) AS pct FROM sums""",
    "snapshot_full_outer": f"""WITH {FACTS} SELECT brand, week_key, channel, region, a.spend_midpoint AS spend_prev,
  b.spend_midpoint AS spend_cur, CASE WHEN a.spend_midpoint IS NULL THEN 'added' WHEN b.spend_midpoint IS NULL THEN 'removed'
    WHEN a.spend_midpoint <> b.spend_midpoint THEN 'changed' ELSE 'kept' END AS state
FROM {SNAP_1} a FULL JOIN facts b USING (brand, week_key, channel, region)""",
    "scan_text_files": f"WITH {SMUGGLED}, {HITS} SELECT * FROM hits",
    "cast_dates": f"""WITH {CREATIVES} SELECT source_id, source,
  CASE WHEN impression_lower % 7000 <> 0 THEN strftime(started_running, '%Y-%m-%d') END AS started_running,
  strftime(stopped_running, '%Y-%m-%d') AS stopped_running,
  CASE WHEN impression_lower % 7000 <> 0 THEN strftime(ingested_at, '%Y-%m-%d %H:%M:%S') END AS ingested_at FROM creatives""",
    "spend_midpoint": f"""WITH {CREATIVES}, gaps AS (
  SELECT source_id, source, CASE WHEN impression_lower % 7000 <> 0 THEN spend_lower END AS lo, spend_upper AS up FROM creatives)
SELECT source_id, source, CAST(lo AS DOUBLE) AS spend_lower, CAST(up AS DOUBLE) AS spend_upper,
  CAST(coalesce(lo, 0) + up AS DOUBLE) / 2 AS spend_midpoint FROM gaps""",
    "clean_nulls": f"""WITH {CREATIVES} SELECT source_id, source, coalesce(cta, 'unknown') AS cta,
  CASE WHEN region = 'ASIA' THEN 'unknown' ELSE region END AS region,
  CASE WHEN platform = 'Brand#13' THEN 'unknown' ELSE platform END AS platform,
  CASE WHEN impression_lower % 7000 = 0 THEN 0.0 ELSE CAST(spend_lower AS DOUBLE) END AS spend_lower,
  CAST(spend_upper AS DOUBLE) AS spend_upper, impression_lower FROM creatives""",
    "brand_slug": "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM part",
    "filter_brand_channels": f"WITH {FACTS} SELECT {FACT} FROM facts WHERE brand = 'building' AND channel IN ('search', 'video')",
    "min_history_guard": f"""WITH {FACTS} SELECT brand, channel, count(DISTINCT week_key) AS n_weeks, brand_weeks,
  count(DISTINCT week_key) >= 4 AS can_forecast, brand_weeks >= 8 AS can_score
FROM facts JOIN (SELECT brand, count(DISTINCT week_key) AS brand_weeks FROM facts GROUP BY brand) USING (brand)
GROUP BY brand, channel, brand_weeks""",
    "signal_projection": f"""WITH {FACTS} SELECT brand, channel, week_key, spend_midpoint, ad_count,
  round(channel_share, 6) AS channel_share FROM facts""",
    "fill_features": f"""WITH {FACTS}, {FEATURES} SELECT brand, week_key, spend_midpoint, active_ad_count, impression_upper_sum,
  CASE WHEN week_key >= '1998-W01' THEN round(channel_share, 6) ELSE 0 END AS channel_share FROM features""",
    "recent_weeks_semi": f"""WITH {FACTS} SELECT {FACT} FROM facts SEMI JOIN (
  SELECT brand, week_key FROM (SELECT DISTINCT brand, week_key FROM facts)
  QUALIFY row_number() OVER (PARTITION BY brand ORDER BY week_key DESC) <= 4) recent USING (brand, week_key)""",
    "anti_existing": f"""WITH {CREATIVES} SELECT DISTINCT source_id, source FROM creatives
WHERE (source_id, source) NOT IN ({OLD_KEYS})""",
    "attach_total": f"""WITH {FACTS} SELECT brand, week_key, channel, region, spend_midpoint,
  CAST(sum(CAST(spend_midpoint AS DECIMAL(20,5))) OVER w AS DOUBLE) AS brand_week_spend, round(channel_share, 6) AS channel_share,
  round(CASE WHEN sum(CAST(spend_midpoint AS DECIMAL(20,5))) OVER w = 0 THEN 0 ELSE
    CAST(sum(CAST(spend_midpoint AS DECIMAL(20,5))) OVER c AS DOUBLE) / CAST(sum(CAST(spend_midpoint AS DECIMAL(20,5))) OVER w AS DOUBLE)
    END, 6) AS channel_share_total
FROM facts WINDOW w AS (PARTITION BY brand, week_key), c AS (PARTITION BY brand, week_key, channel)""",
    "anomaly_flag_join": f"""WITH {FACTS}, {FEATURES}, {FLAGS} SELECT brand, week_key, spend_midpoint, active_ad_count,
  impression_upper_sum, round(channel_share, 6) AS channel_share, score, is_anomaly FROM features JOIN flags USING (brand, week_key)""",
    "summary_assemble": f"""WITH {summary()}
SELECT brand, 'ok' AS status, dominant_trend, n_anomalies, weeks_analysed, (SELECT count(DISTINCT channel) FROM ends e WHERE e.brand = seen.brand) AS n_channels,
  array_to_string(themes, '|') AS top_themes FROM {PARTS} {NOBODY}""",
    "summary_filtered": f"""WITH {summary(channels="'search', 'video'")}
SELECT brand, 'ok' AS status, dominant_trend, n_anomalies, weeks_analysed, CAST(2 AS BIGINT) AS n_channels,
  array_to_string(themes, '|') AS top_themes FROM {PARTS} {NOBODY}""",
    "weekly_signals": f"""WITH {FULL} SELECT {FACT}, array_to_string(top_ctas, '|') AS top_ctas,
  array_to_string(top_themes, '|') AS top_themes FROM full_facts""",
    "top_ctas": f"WITH {FULL} SELECT * FROM cta_counts WHERE rank <= 3",
    "top_themes": f"WITH {FULL} SELECT * FROM theme_counts WHERE rank <= 5",
    "active_count": f"WITH {FACTS} SELECT brand, week_key, channel, region, ad_count, active_ad_count FROM facts",
    "brand_weekly_features": f"""WITH {FACTS}, {FEATURES} SELECT brand, week_key, spend_midpoint, active_ad_count,
  impression_upper_sum, round(channel_share, 6) AS channel_share FROM features""",
    "channel_mix": f"WITH {FACTS}, {mix()} SELECT * FROM mix",
    "weekly_totals": f"WITH {FACTS}, {totals()} SELECT * FROM totals",
    "brand_top_themes": f"WITH {FULL}, {brand_themes()} SELECT * FROM brand_themes",
    "dominant_trend": f"WITH {FACTS}, {SERIES}, {dominant('halves')} SELECT * FROM dominant",
    "kpis": f"""WITH {FACTS} SELECT brand, {SPEND} AS total_spend, CAST(sum(ad_count) AS BIGINT) AS total_ads,
  count(DISTINCT week_key) AS n_weeks, count(DISTINCT channel) AS n_channels
FROM facts GROUP BY brand UNION ALL SELECT 'nobody', 0, 0, 0, 0""",
    "kpis_filtered": f"""WITH {FACTS} SELECT brand, {SPEND} AS total_spend, CAST(sum(ad_count) AS BIGINT) AS total_ads,
  count(DISTINCT week_key) AS n_weeks, count(DISTINCT channel) AS n_channels
FROM facts WHERE channel IN ('search', 'video') GROUP BY brand UNION ALL SELECT 'nobody', 0, 0, 0, 0""",
    "trend_wide": f"""WITH {FACTS} SELECT * FROM (
  PIVOT (SELECT brand, week_key, channel, CAST(spend_midpoint AS DECIMAL(20,5)) AS s FROM facts)
  ON channel IN ('ctv', 'display', 'search', 'social', 'video') USING CAST(sum(s) AS DOUBLE) GROUP BY brand, week_key)""",
    "fill_weeks": f"""WITH {FACTS}, part AS (
  SELECT brand, channel, week_key, {SPEND} AS spend FROM facts WHERE CAST(substr(week_key, 7, 2) AS INT) % 3 <> 0 GROUP BY ALL),
mondays AS (SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS week_key, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders),
ends AS (SELECT brand, channel, min(monday) AS a, max(monday) AS b FROM part JOIN mondays USING (week_key) GROUP BY ALL),
grid AS (SELECT brand, channel, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS monday FROM ends)
SELECT g.brand, g.channel, strftime(monday, '%G-W%V') AS week_key, coalesce(spend, 0) AS spend FROM grid g
LEFT JOIN part p ON p.brand = g.brand AND p.channel = g.channel AND p.week_key = strftime(monday, '%G-W%V')""",
    "weeks_analysed": f"WITH {FACTS} SELECT brand, count(DISTINCT week_key) AS weeks_analysed FROM facts GROUP BY brand",
    "trend_series": f"WITH {FACTS} SELECT brand, channel, week_key, {SPEND} AS spend FROM facts GROUP BY ALL",
    "sorted_dims": f"""WITH {CREATIVES}, dims AS (SELECT DISTINCT 'brand' AS dim, brand AS value FROM creatives
UNION ALL SELECT DISTINCT 'channel', channel FROM creatives)
SELECT *, row_number() OVER (ORDER BY dim, value) AS place FROM dims""",
    "load_counts": f"""WITH {CREATIVES} SELECT (SELECT count(*) FROM creatives) AS docs_read,
  (SELECT count(DISTINCT (source_id, source)) FROM creatives) AS raw_rows,
  (SELECT count(DISTINCT (brand, week_key, channel, region)) FROM creatives) AS signal_rows""",
    "channel_share": f"""WITH {FACTS} SELECT brand, week_key, channel, region, spend_midpoint,
  round(channel_share, 6) AS channel_share FROM facts""",
    "trend_pct": f"WITH {FACTS}, {SERIES} SELECT brand, channel, n_weeks, round(pct, 2) AS trend_pct_change FROM halves",
    "trend_direction": f"WITH {FACTS}, {SERIES} SELECT brand, channel, {DIRECTION} AS trend_direction FROM halves",
    "weekly_actuals": f"""WITH {FACTS}, {SERIES} SELECT brand, channel, week_key, round(CAST(spend AS DOUBLE), 2) AS spend
FROM series JOIN shape USING (brand, channel) WHERE rn <= 12 AND n_weeks >= 4""",
    "wow_delta": f"""WITH {FACTS}, weeks AS (
  SELECT brand, week_key, {SPEND} AS spend, CAST(sum(ad_count) AS BIGINT) AS ads FROM facts GROUP BY ALL),
both_weeks AS (
  SELECT *, lag(spend) OVER w AS prev_spend, lag(ads) OVER w AS prev_ads, row_number() OVER (PARTITION BY brand ORDER BY week_key DESC) AS rn
  FROM weeks WINDOW w AS (PARTITION BY brand ORDER BY week_key))
SELECT brand, week_key, CASE WHEN prev_spend > 0 THEN round((spend - prev_spend) / prev_spend * 100, 4) END AS spend_pct,
  CASE WHEN prev_ads > 0 THEN round((ads - prev_ads) / prev_ads * 100, 4) END AS ads_pct FROM both_weeks WHERE rn = 1""",
    "recent_n": f"""WITH {FACTS} SELECT brand, week_key, row_number() OVER (PARTITION BY brand ORDER BY week_key DESC) AS recency
FROM (SELECT DISTINCT brand, week_key FROM facts) QUALIFY recency <= 12""",
    "last_anomalies": f"""WITH {FACTS}, {FEATURES}, {FLAGS} SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY week_key DESC) AS rank,
  week_key FROM flags WHERE is_anomaly QUALIFY rank <= 5""",
    "dedup_first": f"WITH {CREATIVES}, {FIRST} SELECT {SHOWN} FROM first_docs",
    "signals_query": f"""WITH {FACTS} SELECT brand, channel, week_key, spend_midpoint, ad_count, round(channel_share, 6) AS channel_share,
  row_number() OVER (ORDER BY week_key DESC, channel, region) AS place
FROM facts WHERE brand = 'building' ORDER BY place LIMIT 100""",
    "top_n_per_key": f"""WITH {CREATIVES} SELECT brand, channel, theme, count(*) AS n_ads,
  row_number() OVER (PARTITION BY brand, channel ORDER BY count(*) DESC, theme) AS rank
FROM (SELECT brand, channel, unnest(creative_themes) AS theme FROM creatives) GROUP BY brand, channel, theme QUALIFY rank <= 3""",
    "mix_desc": f"""WITH {FACTS}, {mix()} SELECT *, row_number() OVER (PARTITION BY brand ORDER BY pct DESC, channel) AS rank FROM mix""",
    "tail_weeks": f"""WITH {FACTS} SELECT week_key, {SPEND} AS spend, row_number() OVER (ORDER BY week_key DESC) AS place FROM facts WHERE brand = 'building'
GROUP BY week_key ORDER BY week_key DESC LIMIT 8""",
    "union_sources": f"""WITH {CREATIVES}, {FIRST} SELECT source_id, source, CASE WHEN source <> 'meta' THEN platform END AS platform,
  CASE WHEN source <> 'google' THEN currency END AS currency, week_key FROM first_docs""",
    "iso_week_key": "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week_key FROM orders",
    "week_key_to_monday": "SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday FROM orders",
    "monday_to_key": f"""WITH {CREATIVES} SELECT DISTINCT week_key, strftime(date_trunc('week', started_running), '%Y-%m-%d') AS monday,
  strftime(date_trunc('week', started_running), '%G-W%V') AS key_of_monday FROM creatives""",
    "channel_of_platform": f"WITH {ADS} SELECT id, platform, channel FROM ads",
    "safe_date_prefix": f"WITH {ADS} SELECT id, strftime(started, '%Y-%m-%d') AS started FROM ads",
    "range_bounds": f"""WITH {ADS} SELECT id, impression_lower, impression_upper, CAST(spend_lower AS DOUBLE) AS spend_lower,
  CAST(spend_upper AS DOUBLE) AS spend_upper FROM ads""",
    "is_active": f"""WITH {ADS} SELECT replace(lower(term), ' ', '-') AS brand, stopped IS NULL AS is_active, count(*) AS n
FROM ads GROUP BY ALL""",
    "title_case": """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(p_name, ' ', '-') || ' & co',
  '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1]) || lower(r[2:])), '') AS display FROM part""",
    "sanitize_text": f"WITH {SMUGGLED} SELECT doc_id, regexp_replace(text, '{INVISIBLE}', '', 'g') AS text FROM smuggled",
    "has_invisible": f"WITH {SMUGGLED} SELECT doc_id, regexp_matches(text, '{INVISIBLE}') AS hit FROM smuggled",
    "scan_invisible": f"WITH {SMUGGLED}, {HITS} SELECT * FROM hits",
    "money_format": """SELECT l_orderkey, l_linenumber, l_partkey, '$' || format('{:,.0f}', l_extendedprice) AS money,
  printf('%+.1f', round((l_discount - l_tax) * 137, 2)) || '%' AS pct FROM lineitem""",
    "array_ops": f"""WITH {CREATIVES}, lists AS (
  SELECT source_id, source, week_key, list_concat(creative_themes, [cta], creative_themes) AS v FROM creatives),
positions AS (
  SELECT *, list_filter(v, lambda x, i: list_position(v, x) = i) AS firsts FROM lists)
SELECT source_id, source, week_key, array_to_string(list_slice(firsts, 1, 3), '|') AS "values" FROM positions""",
    "clamp_forecast": """SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, l_extendedprice - 40000), 2) AS y FROM lineitem""",
    "epoch_ms": """SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g') AS at FROM events""",
    "linear_forecast": f"""WITH {FACTS}, {SERIES} SELECT brand, channel, {DIRECTION} AS trend_direction,
  round(pct, 2) AS trend_pct_change, CAST(step AS BIGINT) AS step, round({LINEAR}, 2) AS value FROM ends, {STEPS} WHERE n_weeks >= 4""",
    "ols_forecast": f"""WITH {FACTS}, {SERIES}, fit AS (
  SELECT brand, channel, count(*) AS n, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM (
    SELECT brand, channel, CAST(spend AS DOUBLE) AS y, CAST(row_number() OVER (PARTITION BY brand, channel ORDER BY week_key) AS DOUBLE) AS i FROM series)
  GROUP BY brand, channel)
SELECT brand, channel, CAST(step AS BIGINT) AS step, round(greatest(0, a + b * (n + step)), 2) AS value FROM fit, {STEPS} WHERE n >= 4""",
    "forecast_all": f"""WITH {FACTS}, {SERIES} SELECT brand, channel, coalesce(n_weeks, 0) AS n_weeks,
  CASE WHEN pct IS NULL THEN 'flat' ELSE {DIRECTION} END AS trend_direction, coalesce(round(pct, 2), 0) AS trend_pct_change,
  CAST(CASE WHEN n_weeks >= 4 THEN 4 ELSE 0 END AS BIGINT) AS n_steps
FROM (SELECT DISTINCT brand, unnest(['social', 'search', 'video', 'display', 'ctv', 'radio']) AS channel FROM facts) LEFT JOIN ends USING (brand, channel)""",
    "contamination_cut": f"""WITH {FACTS}, {FEATURES}, {FLAGS} SELECT brand, week_key,
  n_weeks >= 8 AND -score < quantile_cont(-score, 0.15) OVER (PARTITION BY brand) AS is_anomaly FROM flags""",
    "robust_anomaly": f"WITH {FACTS}, {FEATURES}, {FLAGS} SELECT * FROM flags",
    "snapshot_run": f"""WITH {CREATIVES}, {FIRST_BY_LOAD}, {facts('first_docs')}, {tops('first_docs')}
SELECT {FACT}, array_to_string(top_ctas, '|') AS top_ctas, array_to_string(top_themes, '|') AS top_themes FROM full_facts""",
    "trend_forecast_shape": f"""WITH {FACTS}, {SERIES} SELECT brand, channel, n_weeks, {DIRECTION} AS trend_direction,
  round(pct, 2) AS trend_pct_change, CASE WHEN n_weeks >= 4 THEN true END AS converged,
  CASE WHEN n_weeks >= 4 THEN 4 ELSE 0 END AS n_steps, true AS none_below_0,
  coalesce((SELECT string_agg(week_key, '|' ORDER BY week_key) FROM series s WHERE s.brand = h.brand AND s.channel = h.channel AND rn <= 12 AND n_weeks >= 4), '') AS weeks,
  coalesce((SELECT string_agg(CAST(round(round(CAST(spend AS DOUBLE), 2) * 100) AS BIGINT), '|' ORDER BY week_key) FROM series s
    WHERE s.brand = h.brand AND s.channel = h.channel AND rn <= 12 AND n_weeks >= 4), '') AS cents FROM halves h""",
    "isolation_counts": f"""WITH {FACTS} SELECT brand, CASE WHEN n >= 8 THEN n ELSE 0 END AS n_scored,
  CASE WHEN n >= 8 THEN CAST(ceil(0.15 * (n - 1)) AS BIGINT) ELSE 0 END AS n_flagged, true AS in_range
FROM (SELECT brand, count(DISTINCT week_key) AS n FROM facts GROUP BY brand)""",
    "anomaly_result": f"""WITH {FACTS}, {FEATURES}, {FLAGS} SELECT brand,
  coalesce(string_agg(week_key, '|' ORDER BY week_key) FILTER (WHERE is_anomaly), '') AS anomaly_weeks,
  count(*) FILTER (WHERE is_anomaly) AS n_anomalies, count(score) AS n_scores,
  'spend_midpoint|channel_share|active_ad_count|impression_upper_sum' AS features_used FROM flags GROUP BY brand""",
    "signal_summary_models_shape": f"""WITH {FULL}, {SERIES}, {dominant('halves')},
seen AS (SELECT brand, count(DISTINCT week_key) AS weeks_analysed FROM facts GROUP BY brand),
trends AS (SELECT brand, string_agg(channel || ': ' || {DIRECTION} || ' (' || printf('%+.1f', round(pct, 2)) || '%)', ' | ' ORDER BY channel) AS trends
  FROM halves GROUP BY brand)
SELECT brand, 'ok' AS status, dominant_trend, CAST(ceil(0.15 * (weeks_analysed - 1)) AS BIGINT) AS n_anomalies, weeks_analysed, trends,
  CAST(ceil(0.15 * (weeks_analysed - 1)) AS BIGINT) AS n_weeks_listed FROM seen JOIN dominant USING (brand) JOIN trends USING (brand)
UNION ALL SELECT 'nobody', 'no_data', NULL, NULL, NULL, NULL, NULL""",
    "signal_summary": f"""WITH {summary()},
spent AS (SELECT brand, string_agg(week_key || '=' || CAST(round(spend * 100) AS BIGINT), '|' ORDER BY week_key) AS totals FROM totals GROUP BY brand),
recent AS (SELECT brand, list(week_key ORDER BY week_key) AS weeks4 FROM (
  SELECT brand, week_key FROM totals QUALIFY row_number() OVER (PARTITION BY brand ORDER BY week_key DESC) <= 4) GROUP BY brand)
SELECT brand, 'ok' AS status, dominant_trend, n_anomalies, weeks_analysed, mix, trends, totals,
  coalesce(array_to_string(weeks, '|'), '') AS anomaly_weeks, array_to_string(themes, '|') AS top_themes,
  array_to_string(weeks4, '|') AS recent_weeks FROM {PARTS} LEFT JOIN spent USING (brand) LEFT JOIN recent USING (brand)""",
    "brief_context": f"WITH {summary()} SELECT brand, 'ok' AS status, {CONTEXT} AS context FROM {PARTS}",
    "generate_briefs": f"WITH {CREATIVES} SELECT brand, {BRIEF} AS brief FROM (SELECT DISTINCT brand FROM creatives)",
    "brief_response": f"""WITH {summary()} SELECT brand, {BRIEF} AS brief, dominant_trend,
  coalesce(array_to_string(weeks, '|'), '') AS anomaly_weeks, array_to_string(themes, '|') AS top_themes, weeks_analysed FROM {PARTS}""",
    "saved_briefs": f"""WITH {summary()} SELECT brand, {BRIEF} AS brief, dominant_trend,
  coalesce(array_to_string(weeks, '|'), '') AS anomaly_weeks, array_to_string(themes, '|') AS top_themes, weeks_analysed FROM {PARTS}""",
    "stream_two_feeds": f"""WITH {CREATIVES}, {FIRST}, {facts('first_docs')}, {tops('first_docs')}
SELECT {FACT}, array_to_string(top_ctas, '|') AS top_ctas, array_to_string(top_themes, '|') AS top_themes FROM full_facts""",
    "stream_weekly_signals": f"""WITH {CREATIVES} SELECT brand, channel, region, week_key,
  strftime(date_trunc('week', started_running), '%Y-%m-%d') AS monday, count(*) AS ad_count,
  count(*) FILTER (WHERE is_active) AS active_ad_count, CAST(sum(impression_lower) AS BIGINT) AS impression_lower_sum,
  CAST(sum(impression_upper) AS BIGINT) AS impression_upper_sum, CAST(sum(spend_lower) AS DOUBLE) AS spend_lower_sum,
  CAST(sum(spend_upper) AS DOUBLE) AS spend_upper_sum, CAST(sum(spend_lower) + sum(spend_upper) AS DOUBLE) / 2 AS spend_midpoint
FROM creatives GROUP BY ALL""",
    "stream_dedup": "SELECT event_id, event_type, user_id, value FROM events",
    "stream_dedup_within": f"""WITH {RESENT}
SELECT event_id, time FROM (
  SELECT *, lag(ts) OVER (PARTITION BY event_id ORDER BY batch) AS held FROM passing)
WHERE held IS NULL OR older >= held + INTERVAL 6 DAYS""",
    "stream_windows_closed": f"""WITH {LATE}
SELECT brand, channel, region, {WINDOW_SUMS} FROM sent JOIN marks USING (batch)
WHERE (older IS NULL OR monday + 7 > older) AND monday + 7 <= after GROUP BY brand, channel, region, sent.monday""",
    "stream_windows_corrected": f"""WITH {LATE}
SELECT brand, channel, region, {WINDOW_SUMS}, sent.monday + 7 <= any_value(after) AS closed,
  count(*) FILTER (WHERE sent.monday + 7 <= before) AS late_ads
FROM sent JOIN marks USING (batch) GROUP BY brand, channel, region, sent.monday""",
    "stream_upsert_sink": f"""WITH {CREATIVES}, {FIRST}, {facts('first_docs')}, {tops('first_docs')}
SELECT {FACT}, array_to_string(top_ctas, '|') AS top_ctas, array_to_string(top_themes, '|') AS top_themes FROM full_facts""",
}
SQL["quarantine"] = SQL["quarantine_column"] = f"""WITH {CREATIVES}, d AS (SELECT source_id, impression_lower AS n FROM creatives)
SELECT source_id, CASE WHEN n % 11000 <> 0 THEN n END AS impression_lower, 'kept' AS state FROM d WHERE n % 7000 <> 0
UNION ALL SELECT source_id, NULL, CASE WHEN n % 7000 = 0 THEN 'document' ELSE 'value' END FROM d WHERE n % 7000 = 0 OR n % 11000 = 0"""

SQL["snapshot_changes"] = f"""WITH {FACTS}, b AS (
  SELECT *, brand = 'building' AND week_key BETWEEN '1997-W10' AND '1997-W20'
    -- a replacement stands for the groups that it holds rows of
    AND bool_or(channel <> 'ctv') OVER (PARTITION BY brand, week_key) AS replaced FROM facts)
SELECT brand, week_key, channel, region, CASE WHEN week_key < '1998-W01' THEN spend_midpoint END AS spend_prev,
  CASE WHEN replaced AND channel = 'ctv' THEN NULL WHEN replaced THEN spend_midpoint + 100 ELSE spend_midpoint END AS spend_cur,
  CASE WHEN week_key >= '1998-W01' THEN 'added' WHEN channel = 'ctv' THEN 'removed' ELSE 'changed' END AS state
FROM b WHERE week_key >= '1998-W01' OR replaced"""

for _name in ("run_then_stream", "stream_then_run"):
    SQL[_name] = SQL["stream_two_feeds"]
