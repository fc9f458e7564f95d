"""Model attributes, text, catalogue and telemetry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, weibull_math
from ..functions.staging_area import new_folder
from ..operators import dims, enrich, strata
from ..plans.score import parse_descriptors
from ..sources import attributes, catalogue, smart_schema, telemetry
from . import views as v
from .registry import query

W = "WITH "

# Hand-kept attribute lines out of part: comments, blank lines, tab runs, short rows and partial dates.
DATE_TEXT = """CASE p_partkey % 4 WHEN 0 THEN (2000 + p_size % 17) || '-' || lpad(CAST(1 + p_size % 12 AS {0}), 2, '0') || '-15'
  WHEN 1 THEN (2000 + p_size % 17) || '-' || lpad(CAST(1 + p_size % 12 AS {0}), 2, '0')
  WHEN 2 THEN CAST(2000 + p_size % 17 AS {0}) END"""


def model_lines(spark: SparkSession, sf: str) -> DataFrame:
    date = F.expr(DATE_TEXT.format("string"))
    line = F.concat(
        F.col("p_partkey").cast("string"), F.lit("\t\t"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("\t "),
        F.col("p_name"), F.coalesce(F.concat(F.lit("\t"), date), F.lit("")), F.lit(" # seen"))
    lines = F.array(F.lit("# only a comment"), line, F.lit("   "))
    return v.table(spark, sf, "part").select("p_partkey", F.explode(lines).alias("line"))


LINES = f"""lines AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS db_id, replace(p_brand, '#', '-') AS brand, p_name AS model,
  {DATE_TEXT.format('VARCHAR')} AS first_known_date FROM part)"""
TYPED = LINES + """, typed AS (SELECT upper(model) AS model, p_partkey, CAST(date_diff('day', DATE '2000-01-01', CAST(
  first_known_date || CASE length(first_known_date) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE)) AS INTEGER)
  AS first_known_date FROM lines),
latest AS (SELECT model, first_known_date FROM typed QUALIFY row_number() OVER (PARTITION BY model ORDER BY p_partkey DESC) = 1)"""
HEADER = ("db_id", "brand", "model", "first_known_date")


@query("attribute_lines", "A6", sql=W + LINES + " SELECT * FROM lines")
def attribute_lines(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.parse_lines(model_lines(spark, sf), "line", ["p_partkey"], HEADER)


@query("attribute_table", "A7", sql=W + TYPED + " SELECT * FROM latest")
def attribute_table(spark: SparkSession, sf: str) -> DataFrame:
    return attributes.attribute_table(attribute_lines(spark, sf), order="p_partkey")


@query("attribute_file", "A6 A7", sql=W + TYPED + " SELECT * FROM latest")
def attribute_file(spark: SparkSession, sf: str) -> DataFrame:
    """The same table through files on disk, whose names and lines keep the order."""
    path = new_folder(spark, "attributes")
    head = spark.createDataFrame([(-1, "db_id\tbrand\tmodel\tfirst known date")], "p_partkey bigint, line string")
    lines = head.unionByName(model_lines(spark, sf))
    lines.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("line").write.text(path)
    return attributes.attribute_table(attributes.read_lenient_tsv(spark, path), order="line_no")


# Model names with a vendor word, for normalisation.
@query("normalized_model_names", "B8", sql="""
WITH n AS (SELECT p_partkey, p_brand AS vendor, p_type || ' ' || p_brand || '  ' || p_name || ' X' || p_size AS name FROM part),
r AS (SELECT p_partkey, trim(substr(lower(name), strpos(lower(name), lower(vendor)) + length(vendor))) AS rest,
  lower(name) AS whole FROM n)
SELECT p_partkey, upper(list_reduce(string_split(rest, ' '), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)) AS name,
  upper(list_reduce(string_split(whole, ' '), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)) AS without_vendor
FROM r""")
def normalized_model_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_type", F.lit(" "), "p_brand", F.lit("  "), "p_name", F.lit(" X"), F.col("p_size").cast("string"))
    return v.table(spark, sf, "part").select(
        "p_partkey", text.normalize_model_name(F.col("p_brand"), name).alias("name"),
        text.normalize_model_name(F.lit("no such vendor"), name).alias("without_vendor"))


@query("series_and_modifiers", "B10", sql="""
WITH s AS (SELECT p_partkey, concat_ws(' ', p_type, CASE p_size % 4 WHEN 0 THEN 'RE' || p_size % 7 WHEN 1 THEN 'Black'
  WHEN 2 THEN 'VelociRaptor' ELSE '' END, p_name, p_size) AS t FROM part),
m AS (SELECT *, regexp_extract(t, '(RED|Green|Purple|Gold|Black|Blue|AV|RE\\d?|RE16|Xe|S25|SE16|SE|WD450AA line|Protege|(?:Veloci)?Raptor|My Passport|UltraSlim)', 1) AS s FROM s),
k AS (SELECT *, CASE WHEN s = '' THEN t ELSE substr(t, 1, strpos(t, s) - 1) || substr(t, strpos(t, s) + length(s)) END AS rest FROM m),
w AS (SELECT *, regexp_split_to_array(rest, '\\W') AS tokens FROM k)
SELECT p_partkey, CASE WHEN s = '' THEN 'Old Caviar' ELSE s END AS series,
  CAST(list_filter(tokens, lambda x: regexp_full_match(x, '\\d+'))[-1] AS DOUBLE) / 10 AS form_factor,
  array_to_string(list_sort(list_distinct(list_filter(tokens, lambda x: x <> '' AND NOT regexp_full_match(x, '\\d+')))), ',') AS modifiers
FROM w""")
def series_and_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    middle = F.expr("CASE p_size % 4 WHEN 0 THEN concat('RE', p_size % 7) WHEN 1 THEN 'Black' WHEN 2 THEN 'VelociRaptor' ELSE '' END")
    described = v.table(spark, sf, "part").select(
        "p_partkey", text.series_and_modifiers(
            F.concat_ws(" ", "p_type", middle, "p_name", F.col("p_size").cast("string"))).alias("s"))
    return described.select(
        "p_partkey", "s.series", "s.form_factor",
        F.array_join(F.array_sort(F.map_keys("s.modifiers")), ",").alias("modifiers"))


RULES = (
    enrich.Rule("colour", r"\b(red|blue|green|black)\b"),
    enrich.Rule("colour", r"^(\w)\w* "),
    enrich.Rule("shape", r" (widget|plate|ring|gear|bolt)$"),
    enrich.Rule("name_length_code", r"^\w+ (\w)"),
    enrich.Rule("size", r"(\d+)", 1, "int"),
)
DECODED = """decoded AS (SELECT p_partkey, p_name AS name, p_type, p_size, p_brand,
  coalesce(nullif(regexp_extract(p_name, '\\b(red|blue|green|black)\\b', 1), ''), nullif(regexp_extract(p_name, '^(\\w)\\w* ', 1), '')) AS colour,
  nullif(regexp_extract(p_name, ' (widget|plate|ring|gear|bolt)$', 1), '') AS shape,
  nullif(regexp_extract(p_name, '^\\w+ (\\w)', 1), '') AS name_length_code,
  TRY_CAST(nullif(regexp_extract(p_name, '(\\d+)', 1), '') AS INTEGER) AS size FROM part)"""


def named_parts(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), "p_type", "p_size", "p_brand")


@query("decoded_attributes", "B11", sql=W + DECODED + " SELECT p_partkey, name, colour, shape, name_length_code, size FROM decoded")
def decoded_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return named_parts(spark, sf).select("p_partkey", "name").withColumns(enrich.decode_columns(F.col("name"), RULES))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    table = attribute_table(spark, sf).where(F.col("first_known_date").isNotNull()).select(
        F.lower("model").alias("model"), "first_known_date", F.lit("listed").alias("shape"))
    enrichers = {
        "rules": enrich.rule_enricher([r for r in RULES if r.attribute == "shape"]),
        "table": enrich.table_enricher(table),
    }
    return enrich.enrich(named_parts(spark, sf).select("p_partkey", "name"), enrichers)


ENRICHED = TYPED + ", " + DECODED + """,
side AS (SELECT lower(model) AS model, first_known_date FROM latest WHERE first_known_date IS NOT NULL),
enriched AS (SELECT p_partkey, name, CASE WHEN side.model IS NOT NULL THEN 'listed' ELSE shape END AS shape, side.first_known_date,
  CAST((CASE WHEN shape IS NULL THEN 1 ELSE 0 END) | (CASE WHEN side.model IS NULL THEN 2 ELSE 0 END) AS INTEGER) AS missed
  FROM decoded LEFT JOIN side ON side.model = decoded.name)"""


@query("enriched_models", "D12", sql=W + ENRICHED + " SELECT * FROM enriched")
def enriched_models(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf)


@query("enrichment_coverage", "E17", sql=W + ENRICHED + " SELECT name, CAST(bit_or(missed) AS INTEGER) AS missed FROM enriched GROUP BY name")
def enrichment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.coverage(_enriched(spark, sf))


PUNCHED = """m AS (SELECT p_partkey, p_brand AS brand, p_type, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size,
  CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS p_retailprice FROM part)"""


def punched(spark: SparkSession, sf: str) -> DataFrame:
    known = F.pmod("p_partkey", F.lit(7)) != 0
    return v.table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), "p_type", F.when(known, F.col("p_size")).alias("p_size"),
        F.when(known, F.col("p_retailprice")).alias("p_retailprice"))


@query("repaired_attributes", "B20", sql="""
WITH m AS (SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Western Digital' WHEN 'Brand#2' THEN 'Hitachi' WHEN 'Brand#3' THEN 'HGST' ELSE p_brand END AS brand,
  CASE WHEN p_size % 2 = 0 THEN 3.5e0 ELSE 2.5e0 END AS form_factor, CASE WHEN p_size % 3 = 0 THEN TRUE END AS "Scorpio" FROM part)
SELECT p_partkey, brand, form_factor,
  CASE WHEN brand = 'Western Digital' THEN CASE WHEN form_factor = 3.5 AND "Scorpio" IS NULL THEN FALSE ELSE "Scorpio" END ELSE FALSE END AS "Scorpio",
  CASE WHEN brand <> 'Western Digital' THEN FALSE END AS "Caviar", CASE WHEN brand <> 'Western Digital' THEN FALSE END AS "GP",
  CASE WHEN brand IN ('Hitachi', 'HGST') THEN 'N/A' END AS product_code FROM m""")
def repaired_attributes(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.expr("CASE p_brand WHEN 'Brand#1' THEN 'Western Digital' WHEN 'Brand#2' THEN 'Hitachi' WHEN 'Brand#3' THEN 'HGST' ELSE p_brand END")
    rows = v.table(spark, sf, "part").select(
        "p_partkey", brand.alias("brand"), F.when(F.col("p_size") % 2 == 0, 3.5).otherwise(2.5).alias("form_factor"),
        F.when(F.col("p_size") % 3 == 0, True).alias("Scorpio"))
    return enrich.repair(rows, enrich.brand_repairs())


@query("attribute_domain", "E15 G4", sql=W + PUNCHED + " SELECT DISTINCT p_size FROM m WHERE p_size IS NOT NULL ORDER BY p_size")
def attribute_domain(spark: SparkSession, sf: str) -> DataFrame:
    return strata.attribute_domain(punched(spark, sf), "p_size")


@query("id_domain", "E15", sql="SELECT min(p_partkey) AS low, max(p_partkey) AS high FROM part")
def id_domain(spark: SparkSession, sf: str) -> DataFrame:
    return strata.id_domain(v.table(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query("available_attributes", "E16", sql=W + PUNCHED + """
SELECT 'p_partkey' AS attribute, count(p_partkey) AS models FROM m UNION ALL SELECT 'brand', count(brand) FROM m
UNION ALL SELECT 'p_type', count(p_type) FROM m UNION ALL SELECT 'p_size', count(p_size) FROM m
UNION ALL SELECT 'p_retailprice', count(p_retailprice) FROM m""")
def available_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return strata.available_attributes(punched(spark, sf).withColumn("nowhere", F.lit(None).cast("int")))


@query("subjects_with_attributes", "D11", sql=W + v.SV + ", " + PUNCHED + """
SELECT l_orderkey, l_linenumber, sv.l_partkey AS model_id, duration_worked, failed, m.brand, m.p_size
FROM sv JOIN m ON m.p_partkey = sv.l_partkey""")
def subjects_with_attributes(spark: SparkSession, sf: str) -> DataFrame:
    stats = v.subjects(spark, sf).select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("model_id"), "duration_worked", "failed")
    models = punched(spark, sf).withColumnRenamed("p_partkey", "id")
    out, _missing = enrich.attach_attributes(stats, models, ["brand", "p_size", "no_such_attribute"])
    return out


# The catalogue of download pieces, written into the scripts of the test pages.
SCRIPT = """concat('<script>/* list */ var rawPieces = new DataTable([''title''], ''id'', /*rows*/ [{''title'':''Piece ', page_id, ''',''year'':''', 2010 + page_id % 9, ''',
''dataURL'':''https://example.org/', CASE WHEN page_id % 3 = 0 THEN 'docs' ELSE 'data' END, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('_Q', 1 + page_id % 4) END, '_', page_id, '.zip'',
''metaData'':''', 1 + page_id % 40, '.5 ', CASE WHEN page_id % 2 = 0 THEN 'MB' ELSE 'GB' END, ' ZIP file, ', 3 + page_id % 90, ' GB on disk, ', 10 + page_id % 80, ' files''}]);</script>')"""
PIECES = """pieces AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'docs' ELSE 'data' END ||
  CASE WHEN page_id % 5 = 0 THEN '' ELSE '_Q' || (1 + page_id % 4) END || '_' || page_id || '.zip' AS name, 'Piece ' || page_id AS title,
  CAST(2010 + page_id % 9 AS INTEGER) AS year, CASE WHEN page_id % 3 = 0 THEN 'docs' ELSE 'data' END AS type,
  CAST(CASE WHEN page_id % 5 <> 0 THEN 1 + page_id % 4 END AS INTEGER) AS quarter,
  (1 + page_id % 40 + 0.5e0) * CASE WHEN page_id % 2 = 0 THEN 1 ELSE 1024 END AS compressed_mb, (3 + page_id % 90) * 1024.0e0 AS unpacked_mb,
  CAST(10 + page_id % 80 AS INTEGER) AS files, 'zip' AS format, TRUE AS complete FROM pages),
spans AS (SELECT *, 'https://example.org/' || name AS uri, make_date(year, coalesce(3 * quarter - 2, 1), 1) AS "start",
  CAST(make_date(year, coalesce(3 * quarter - 2, 1), 1) + CASE WHEN quarter IS NULL THEN INTERVAL 12 MONTH ELSE INTERVAL 3 MONTH END AS DATE) AS "end"
  FROM pieces)"""


def catalogue_pages(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "pages").select("page_id", F.concat("html", F.expr(SCRIPT)).alias("html"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    records = catalogue.catalogue_records(catalogue_pages(spark, sf), "html", "rawPieces", "page_id")
    return catalogue.catalogue_pieces(records, "page_id")


@query("catalogue_pieces", "A8 A9", sql=W + PIECES + """
SELECT page_id, name, title, year, type, quarter, uri, compressed_mb, unpacked_mb, files, format, complete,
  CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end" FROM spans""")
def catalogue_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


@query("page_links", "A8", sql="""
SELECT link, count(*) AS mentions, count(DISTINCT page_id) AS pages FROM
  (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) GROUP BY link""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    links = v.table(spark, sf, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    per_page = links.groupBy("link", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("link").agg(F.sum("n").alias("mentions"), F.count("*").alias("pages"))


QUARTERS = v.T1_RAW + """, quarters AS (SELECT DISTINCT CAST(year(DATE '1970-01-01' + day) AS INTEGER) AS year,
  CAST(quarter(DATE '1970-01-01' + day) AS INTEGER) AS quarter FROM t1_raw),
spans AS (SELECT *, make_date(year, 3 * quarter - 2, 1) AS "start", CAST(make_date(year, 3 * quarter - 2, 1) + INTERVAL 3 MONTH AS DATE) AS "end" FROM quarters)"""


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    date = F.date_from_unix_date("day")
    quarters = v.raw_telemetry(spark, sf).select(F.year(date).alias("year"), F.quarter(date).alias("quarter")).distinct()
    return quarters.withColumns({
        "start": catalogue.span_start(F.col("year"), F.col("quarter")),
        "end": catalogue.span_end(F.col("year"), F.col("quarter"))})


@query("quarter_spans", "A10", sql=W + QUARTERS + """
SELECT year, quarter, CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end" FROM spans""")
def quarter_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _quarters(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


@query("newer_pieces", "A11", sql=W + QUARTERS + """
SELECT CAST(min("start") AS VARCHAR) AS "start", CAST(max("end") AS VARCHAR) AS "end", count(*) AS pieces FROM spans
WHERE "start" > DATE '1970-01-01' + (SELECT max(day) FROM t1_raw WHERE day < 10227)""")
def newer_pieces(spark: SparkSession, sf: str) -> DataFrame:
    loaded = v.raw_telemetry(spark, sf).where(F.col("day") < v.CUT).groupBy("drive_id").agg(F.max("day").alias("last_day"))
    span = catalogue.covered_span(catalogue.newer_pieces(_quarters(spark, sf), loaded))
    return span.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


@query("catalogue_tree", "A12", sql=W + PIECES + """
SELECT year, list(name ORDER BY name) FILTER (quarter = 1) AS q1, list(name ORDER BY name) FILTER (quarter = 2) AS q2,
  list(name ORDER BY name) FILTER (quarter = 3) AS q3, list(name ORDER BY name) FILTER (quarter = 4) AS q4,
  list(name ORDER BY name) FILTER (quarter IS NULL) AS whole_year FROM spans GROUP BY year""")
def catalogue_tree(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.catalogue_tree(_pieces(spark, sf))


# Words of the test language stand in for model names: capitalised words with one of two endings.
MENTIONS = (r"[A-Z][a-z]+tion", r"[A-Z][a-z]+ble")


@query("model_mentions", "B22", sql="""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '(?:[A-Z][a-z]+tion)|(?:[A-Z][a-z]+ble)')) AS name FROM pages)
SELECT name, count(*) AS mentions, count(DISTINCT page_id) AS pages FROM m GROUP BY name""")
def model_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return text.model_mentions(v.table(spark, sf, "pages"), "page_id", "html", list(MENTIONS))


# Names in the forms that the seed patterns describe, numbered by the part; some parts keep their own name.
SEED_NAMES = """CASE p_partkey % 7 WHEN 0 THEN concat('ST', 1000 + p_partkey, 'DM', lpad(CAST(p_size AS STRING), 3, '0'))
 WHEN 1 THEN concat('WDC WD', 10 + p_partkey % 90, 'EFRX') WHEN 2 THEN concat('HGST HUS72', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), 'ALE640')
 WHEN 3 THEN concat('Hitachi HDS72', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0'), 'ALE640')
 WHEN 4 THEN concat('TOSHIBA MG04ACA', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), 'E')
 WHEN 5 THEN concat('SAMSUNG HD', lpad(CAST(p_partkey % 1000 AS STRING), 3, '0'), 'UI') ELSE p_name END"""
SEED_PATTERNS = [rx for _, _, _, rx in dims.SEED_BRANDS if rx]
NAMED = f"n AS (SELECT p_partkey, {SEED_NAMES.replace('STRING', 'VARCHAR')} AS name FROM part)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("seed_model_brands", "D4 B7", sql=f"""
WITH {NAMED}, b(id, brand, rx) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(rx)})" for i, n, _, rx in dims.SEED_BRANDS)}),
f AS (SELECT p_partkey, name, min(id) AS id FROM n LEFT JOIN b ON rx <> '' AND regexp_matches(name, rx) GROUP BY ALL)
SELECT brand, count(*) AS models, min(name) AS first_name, max(name) AS last_name FROM f LEFT JOIN b USING (id) GROUP BY brand""")
def seed_model_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of model names by the seed patterns."""
    models = v.table(spark, sf, "part").select("p_partkey", F.expr(SEED_NAMES).alias("name"))
    brands = dims.seed_brands(spark)
    known = dims.classify_models(models, brands).join(
        brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand")), "brand_id", "left")
    return known.groupBy("brand").agg(
        F.count("*").alias("models"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("seed_model_mentions", "B22", sql=f"""
WITH {NAMED}, h AS (SELECT p_partkey, concat('<p>', name, '</p><td>', name, ' and ', reverse(name), '</td>') AS html FROM n),
m AS (SELECT p_partkey, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', chr(10), 'g'), {_quoted("|".join(f"(?:{p})" for p in SEED_PATTERNS))})) AS name FROM h)
SELECT name, count(*) AS mentions, count(DISTINCT p_partkey) AS pages FROM m GROUP BY name""")
def seed_model_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Model names in small pages, by the seed patterns."""
    name = F.expr(SEED_NAMES)
    html = F.concat(F.lit("<p>"), name, F.lit("</p><td>"), name, F.lit(" and "), F.reverse(name), F.lit("</td>"))
    pages = v.table(spark, sf, "part").select("p_partkey", html.alias("html"))
    return text.model_mentions(pages, "p_partkey", "html", SEED_PATTERNS)


@query("whitespace_tokens", "B15", sql="""
SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(text,
  '[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')) AS token FROM documents)
GROUP BY lang, token""")
def whitespace_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.whitespace_tokens(v.table(spark, sf, "documents").select("lang", "text"), "text")
    return tokens.groupBy("lang", "token").agg(F.count("*").alias("n"))


@query("parsed_descriptors", "B14", sql="""
WITH t AS (SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, name, CASE WHEN event_id % 3 = 2 THEN NULL ELSE k END AS k FROM t
UNION ALL SELECT event_id, 'spare', NULL FROM t WHERE event_id % 3 = 0""")
def parsed_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a request: a list of an object and a name, a single object, or a bare name."""
    full = F.concat(F.lit('{"name": "'), "event_type", F.lit('", '), F.substr("props", F.lit(2)))
    request = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), full, F.lit(', "spare"]')))
        .when(F.col("event_id") % 3 == 1, full).otherwise(F.col("event_type")))
    rows = v.table(spark, sf, "events").select("event_id", request.alias("request"))
    return parse_descriptors(rows, "request", {"name": "string", "k": "int"}, "event_id")


@query("weibull_expectation", "B16", sql="""
SELECT p_partkey, round(p_retailprice * gamma(1 + 1 / (0.5e0 + p_size / 10.0e0)), 4) AS expectation FROM part""")
def weibull_expectation(spark: SparkSession, sf: str) -> DataFrame:
    shape = F.lit(0.5) + F.col("p_size") / 10
    return v.table(spark, sf, "part").select(
        "p_partkey", F.round(weibull_math.expectation(F.col("p_retailprice"), shape), 4).alias("expectation"))


@query("weibull_divergence", "B17", sql="""
WITH p AS (SELECT p_partkey, p_retailprice AS l, 1.0e0 + p_size / 25.0e0 AS r, p_retailprice * (1 + (p_partkey % 7) / 20.0e0) AS lt,
  1.0e0 + (p_size + p_partkey % 5) / 25.0e0 AS rt FROM part)
SELECT p_partkey,
  round(ln(rt / lt ** rt) - ln(r / l ** r) + (rt - r) * (ln(lt) - 0.5772156649015329e0 / rt) + (lt / l) ** r * gamma(r / rt + 1) - 1, 6) AS joint,
  round(-ln(r / rt) - (1 - r / rt) * 0.5772156649015329e0 + gamma(r / rt + 1) - 1, 6) AS by_shape,
  round((lt / l) ** rt - rt * ln(lt / l) - 1, 6) AS by_scale FROM p""")
def weibull_divergence(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("l"), (1 + F.col("p_size") / 25).alias("r"),
        (F.col("p_retailprice") * (1 + F.col("p_partkey") % 7 / 20)).alias("lt"),
        (1 + (F.col("p_size") + F.col("p_partkey") % 5) / 25).alias("rt"))
    scale, shape, true_scale, true_shape = (F.col(c) for c in ("l", "r", "lt", "rt"))
    return rows.select(
        "p_partkey", F.round(weibull_math.divergence(scale, shape, true_scale, true_shape), 6).alias("joint"),
        F.round(weibull_math.shape_divergence(shape, true_shape), 6).alias("by_shape"),
        F.round(weibull_math.scale_divergence(scale, true_scale, true_shape), 6).alias("by_scale"))


@query("staged_csv", "A1 A3 A4", sql=W + v.STAGING + " SELECT date, serial_number, model, failure, power_on_hours_raw FROM staging")
def staged_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry through CSV files with headers, repeated headers inside, and files that must be ignored."""
    root = new_folder(spark, "csv")
    names = ["date", "serial_number", "model", "failure", "power_on_hours_raw"]
    rows = v.staging(spark, sf).select(*[F.col(c).cast("string") for c in names])
    stray = spark.createDataFrame([tuple(names)], names)
    rows.unionByName(stray).write.option("header", True).csv(f"{root}/data_2016")
    stray.write.option("header", False).csv(f"{root}/MACOSX/data_2016")
    schema = T.StructType([
        T.StructField("date", T.StringType()), T.StructField("serial_number", T.StringType()),
        T.StructField("model", T.StringType()), T.StructField("failure", T.IntegerType()),
        T.StructField("power_on_hours_raw", T.LongType())])
    return telemetry.read_daily_csv(spark, root, schema)


@query("staged_smart_csv", "A1 A2 A4 A5", sql=W + v.STAGING + """
SELECT date, serial_number, CASE WHEN date LIKE '%-15' THEN NULL ELSE model END AS model, failure,
  CASE WHEN date >= '1998-01-01' THEN power_on_hours_raw * 10 END AS capacity_bytes,
  power_on_hours_raw AS "Power_On_Hours_raw", power_on_hours_raw % 100 AS "Power_On_Hours_normalized",
  CASE WHEN date >= '1998-01-01' THEN power_on_hours_raw % 50 END AS "Temperature_Celsius_raw", 94 AS columns FROM staging""")
def staged_smart_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two layouts and column orders through the full staging schema to the columns of the facts."""
    root = new_folder(spark, "smart")
    hours = F.col("power_on_hours_raw")
    rows = v.staging(spark, sf).withColumn("model", F.when(~F.col("date").endswith("-15"), F.col("model")))
    old = rows.where("date < '1998-01-01'").select(
        "date", "serial_number", "model", "failure", (hours % 100).alias("smart_9_normalized"), hours.alias("smart_9_raw"))
    new = rows.where("date >= '1998-01-01'").select(
        "model", (hours * 10).alias("capacity_bytes"), hours.alias("smart_9_raw"), "serial_number", (hours % 100).alias("smart_9_normalized"),
        "failure", (hours % 50).alias("smart_194_raw"), "date")
    for name, part in (("old", old), ("new", new)):
        part.write.option("header", True).csv(f"{root}/data_{name}")
    staged = smart_schema.prettify(telemetry.read_daily_csv(spark, root, smart_schema.staging_schema()))
    schema = smart_schema.fact_schema()
    head = ["date", "serial_number", "model"]
    facts = telemetry.align_schema(staged.select(*[c for c in staged.columns if c in schema.names]), schema)
    wide = staged.select(*head, *[F.col(f"`{c}`") for c in facts.columns if c in staged.columns])
    return wide.select(
        *head, F.col("failure").cast("int").alias("failure"), "capacity_bytes", "Power_On_Hours_raw",
        F.col("Power_On_Hours_normalized").cast("bigint").alias("Power_On_Hours_normalized"), "Temperature_Celsius_raw",
        F.lit(len(facts.columns) - 4).alias("columns"))


@query("aligned_schema", "A5", sql=W + v.T1_RAW + """
SELECT drive_id, day, CASE WHEN day >= 10227 THEN failure END AS failure, CASE WHEN day >= 10227 THEN power_on_hours_raw END AS power_on_hours_raw,
  CAST(NULL AS DOUBLE) AS temperature FROM t1_raw""")
def aligned_schema(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.raw_telemetry(spark, sf)
    old = rows.where(F.col("day") < v.CUT).select("drive_id", "day")
    both = telemetry.union_aligned(old, rows.where(F.col("day") >= v.CUT))
    wider = T.StructType([*both.schema.fields, T.StructField("temperature", T.DoubleType())])
    return telemetry.align_schema(both, wider)
