"""Sources, sinks, anonymisation, parsing and row-level checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import session
from rankloom.catalog.common import TIES, TIES_SQL, r_sql, rnd, rounded, table
from rankloom.functions import bins, geo, hashing, parsing
from rankloom.operators import anonymise, assemble, cleaning, filters, quality, sentiment, spatial
from rankloom.sources import raw, schemas, sinks

QUERIES, SQL = {}, {}
SALT = "pepper"


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _scratch(spark) -> str:
    import uuid

    return f"{session.stage_root(spark)}/rankloom/{uuid.uuid4().hex}"


@register("""
SELECT c_custkey AS listing_id, CAST(DATE '2026-06-29' + CAST(c_nationkey AS INT) AS DATE) AS date,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal > 5000 END AS available
FROM customer""")
def raw_calendar_scan(spark, folder):
    """Gzip CSV with a declared schema, missing tokens and flags, back to typed rows."""
    day = F.date_add(F.lit("2026-06-29").cast("date"), F.col("c_nationkey"))
    flag = F.when(F.col("c_acctbal") < 0, "N/A").when(F.col("c_acctbal") > 5000, "t").otherwise("f")
    source = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("listing_id"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        flag.alias("available"),
        F.lit(1).alias("minimum_nights"),
        F.lit(30).alias("maximum_nights"),
    )
    path = _scratch(spark)
    source.write.option("header", True).option("compression", "gzip").csv(path)
    from rankloom.operators.cleaning import clean_calendar

    calendar = raw.require_ids(raw.load_raw(spark, path, "calendar"), "calendar")
    return clean_calendar(calendar)


@register()
def file_manifest(spark, folder):
    """Size and SHA-256 of every table file."""
    return raw.manifest(spark, folder).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "size_bytes", "sha256"
    )


_TEXT = "coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_DIGESTED = ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")


@register("""
WITH h AS (SELECT CAST('0x' || substr(md5(""" + " || ".join(_TEXT.format(c=c) for c in _DIGESTED) + """), 1, 15) AS HUGEINT) AS h FROM orders)
SELECT count(*) AS rows, sha256(count(*) || ':' || CAST(sum(h) AS HUGEINT)) AS digest FROM h""")
def table_content_digest(spark, folder):
    """Order-free digest of orders."""
    return sinks.table_digest(table(spark, folder, "orders", *_DIGESTED))


@register("""
SELECT sha256('pepper:' || c_custkey) AS id, sha256('pepper:' || c_nationkey) AS host_id, c_acctbal AS price,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' WHEN c_mktsegment = 'BUILDING' THEN 'local' ELSE 'foreign' END AS host_is_local,
  c_mktsegment <> 'HOUSEHOLD' AS host_has_about, sha256('pepper:' || c_name) AS license_hash,
  'registered' AS license_status
FROM customer""")
def anonymised_listings(spark, folder):
    """Personal columns dropped, ids and licence hashed, host facts derived from what is dropped."""
    kind = F.col("c_mktsegment")
    named = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("host_id"), F.col("c_acctbal").alias("price"),
        F.when(kind == "BUILDING", "Crete, Greece").when(kind != "MACHINERY", "Berlin").alias("host_location"),
        F.when(kind == "HOUSEHOLD", " \n").otherwise(kind).alias("host_about"), F.col("c_name").alias("license"),
        *[F.col("c_name").alias(c) for c in schemas.PII_DROP])
    return anonymise.anonymise_listings(named, SALT)


@register("SELECT sha256('pepper:' || l_partkey) AS listing_id, l_shipdate AS date, l_quantity AS available FROM lineitem")
def anonymised_calendar(spark, folder):
    """Calendar rows with the listing hashed."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("listing_id"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("available"))
    return anonymise.anonymise_calendar(rows, SALT)


@register("SELECT sha256('pepper:' || user_id) AS listing_id, event_id AS id, props AS comments FROM events")
def anonymised_reviews(spark, folder):
    """Reviews without their reviewer, the listing hashed."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("listing_id"), F.col("event_id").alias("id"), F.col("props").alias("comments"),
        F.col("user_id").alias("reviewer_id"), F.col("event_type").alias("reviewer_name"))
    return anonymise.anonymise_reviews(rows, SALT)


@register("""
SELECT o_custkey AS id, CAST(floor(o_totalprice) AS DOUBLE) AS price, CAST(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 2.5 END AS DOUBLE) AS bathrooms,
  o_orderstatus = 'F' AS bathrooms_shared, 'athens' AS city, CAST(o_orderdate AS DATE) AS scrape_date,
  CAST(12 * (o_custkey % 10) + o_custkey % 12 AS INT) AS host_tenure_months, o_orderpriority = '1-URGENT' AS host_is_superhost,
  CAST(o_orderdate AS DATE) - 30 AS first_review
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) WHERE nth = 1""")
def cleaned_listings(spark, folder):
    """Raw listings typed, their first occurrence per id kept, tenure and bathrooms derived."""
    orders = table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    known = {
        "id": F.col("o_custkey"), "_row": F.col("o_orderkey"), "last_scraped": day,
        "price": F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 2)),
        "amenities": F.lit('["Wifi", "Pool"]'), "bathrooms": F.lit(None).cast("double"),
        "bathrooms_text": F.when(F.col("o_orderstatus") == "F", "1 shared bath").otherwise("2.5 baths"),
        "host_is_superhost": F.when(F.col("o_orderpriority") == "1-URGENT", "t").otherwise("f"),
        "first_review": F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd"),
        "hosts_time_as_host_years": F.col("o_custkey") % 10, "hosts_time_as_host_months": F.col("o_custkey") % 12,
    }
    declared = schemas.schema(schemas.LISTINGS)
    rows = orders.select(*[
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in declared], known["_row"].alias("_row"))
    return cleaning.clean_listings(rows, "athens").select(
        "id", "price", "bathrooms", "bathrooms_shared", "city", "scrape_date",
        F.col("host_tenure_months").cast("int").alias("host_tenure_months"), "host_is_superhost", "first_review")


@register("SELECT user_id AS listing_id, event_id AS id, CAST(ts AS DATE) AS date, props AS comments FROM events")
def cleaned_reviews(spark, folder):
    """Reviews with a typed date."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("listing_id"), F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("props").alias("comments"))
    return cleaning.clean_reviews(rows)


@register("""
SELECT o_orderkey, o_totalprice, lines, shipped FROM orders JOIN (SELECT l_orderkey, count(*) AS lines, max(l_shipdate) AS shipped
  FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey""")
def joined_one_to_one(spark, folder):
    """Orders beside the totals of their lines, both proven to have one row per order."""
    totals = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.max("l_shipdate").alias("shipped"))
    return quality.join_one_to_one(
        table(spark, folder, "orders", "o_orderkey", "o_totalprice"), totals, ["o_orderkey"])


@register("""
SELECT count(*) AS rows, count(DISTINCT p_brand) AS query_groups, CAST(2 AS BIGINT) AS features FROM part""")
def checked_feature_table(spark, folder):
    """A feature table that passes every check, with its headline counts."""
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("query_group"), F.col("p_type").alias("cluster_id"),
        (F.col("p_size") % 5).alias("grade"), F.col("p_retailprice").alias("blocked_fraction_90"), "p_size", "p_name")
    counts = assemble.check_feature_table(rows)
    return spark.createDataFrame([tuple(counts.values())], "rows long, query_groups long, features long")


@register("SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0")
def sealed_candidates(spark, folder):
    """Candidates that the guard lets through: all of them lie in the sealed fold."""
    rows = table(spark, folder, "customer").withColumn("fold", F.col("c_nationkey") % 5)
    return quality.require_sealed(rows.filter("fold = 0"), "fold").select("c_custkey")


@register("""
SELECT c_mktsegment AS city, count(*) AS n, """ + r_sql("sum(c_acctbal)", 2) + """ AS balance
FROM customer GROUP BY ALL""")
def processed_partition_sink(spark, folder):
    """Partitioned parquet write and a pruned read back."""
    path = _scratch(spark)
    sinks.write_entity(
        table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "city"), path
    )
    back = sinks.read_columns(spark, path, ["city", "c_acctbal"])
    return back.groupBy("city").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("c_acctbal"), 2).alias("balance")
    )


@register("""
SELECT l_suppkey, count(*) AS rows, true AS one_run FROM lineitem GROUP BY ALL""")
def feature_table_sink(spark, folder):
    """Sorted sink: every group occupies one unbroken run of the written order."""
    path = _scratch(spark)
    lines = table(spark, folder, "lineitem", "l_suppkey", "l_orderkey")
    sinks.write_feature_table(lines, path, "l_suppkey", "l_orderkey")
    files = spark.read.parquet(path).withColumn("_file", F.input_file_name())
    spans = files.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("_file").alias("_a"),
        F.max("_file").alias("_b"),
        F.countDistinct("_file").alias("_files"),
    )
    # Range-partitioned files follow each other by number, so a group spans neighbouring files.
    number = lambda c: F.regexp_extract(c, r"part-(\d+)", 1).cast("int")
    run = number(F.col("_b")) - number(F.col("_a")) + 1 == F.col("_files")
    return spans.select("l_suppkey", "rows", run.alias("one_run"))


@register("""
SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def json_source_sink(spark, folder):
    """JSON lines written and read back with a declared schema."""
    path = _scratch(spark)
    sinks.write_json(table(spark, folder, "nation"), path)
    return sinks.read_json(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@register("""
SELECT o_orderstatus, count(*) AS orders, """ + r_sql("avg(o_totalprice)", 4) + """ AS mean_price
FROM orders GROUP BY ALL""")
def report_csv_sink(spark, folder):
    """A finished report through one CSV file."""
    report = table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), rnd(F.avg("o_totalprice"), 4).alias("mean_price")
    )
    path = _scratch(spark)
    sinks.write_report_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@register("""
SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'scored' ELSE 'cached' END AS origin
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def read_through_cache(spark, folder):
    """Documents already labelled come from the cache; only the others are "scored"."""
    cached = table(spark, folder, "labels").select("doc_id", "quality", F.lit("cached").alias("origin"))
    wanted = table(spark, folder, "documents", "doc_id")

    def score(fresh):
        return fresh.select(
            "doc_id", F.lit(None).cast("int").alias("quality"), F.lit("scored").alias("origin")
        )

    return sinks.read_through(wanted, cached, ["doc_id"], score)


@register("""
SELECT c_custkey, sha256('pepper:' || c_custkey) AS id_hash,
  sha256('pepper:' || c_custkey) AS id_hash_from_double,
  CASE WHEN c_nationkey > 4 THEN sha256('pepper:' || c_nationkey) END AS nation_hash
FROM customer""")
def salted_hash_columns(spark, folder):
    """Digest of a key, the same key widened to double, and a nullable key."""
    df = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    wide = F.col("c_custkey").cast("double")
    sometimes = F.when(F.col("c_nationkey") > 4, F.col("c_nationkey"))
    kinds = {c: df.schema[c].dataType for c in df.columns}
    from pyspark.sql import types as T

    return df.select(
        "c_custkey",
        hashing.salted_hash(F.col("c_custkey"), SALT, kinds["c_custkey"]).alias("id_hash"),
        hashing.salted_hash(wide, SALT, T.DoubleType()).alias("id_hash_from_double"),
        hashing.salted_hash(sometimes, SALT, kinds["c_nationkey"]).alias("nation_hash"),
    )


@register("""
SELECT p_partkey,
  CASE WHEN p_type = 'PROMO' THEN 'unknown' WHEN p_type LIKE '%ECO%' THEN 'local'
    ELSE 'foreign' END AS is_local,
  p_type NOT IN ('PROMO', 'SMALL') AS has_about,
  CASE WHEN p_type = 'SMALL' THEN 'missing' WHEN p_type = 'LARGE' THEN 'exempt'
    ELSE 'registered' END AS license_status
FROM part""")
def host_flags(spark, folder):
    """Home market, bio presence and licence status."""
    kind = F.col("p_type")
    location = F.when(kind != "PROMO", F.initcap(kind))
    about = F.when(kind == "SMALL", "  \t ").when(kind != "PROMO", kind)
    license_text = F.when(kind == "SMALL", " ").when(kind == "LARGE", " Exempt ").otherwise(kind)
    return table(spark, folder, "part").select(
        "p_partkey",
        parsing.host_is_local(location, "eco").alias("is_local"),
        parsing.is_present(about).alias("has_about"),
        parsing.license_status(license_text).alias("license_status"),
    )


@register("""
SELECT o_orderkey,
  CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS price,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS order_date,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag,
  CAST(12 * (o_orderkey % 9) + o_custkey % 12 AS INT) AS tenure
FROM orders""")
def parsed_columns(spark, folder):
    """Prices, dates, flags and tenures from raw text."""
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    )
    day = F.when(
        F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    flag = F.when(F.col("o_orderstatus") == "F", "t").when(F.col("o_orderstatus") == "O", "f")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        parsing.parse_price(price).alias("price"),
        parsing.parse_date(day).alias("order_date"),
        parsing.parse_flag(flag).alias("flag"),
        parsing.tenure_months(F.col("o_orderkey") % 9, F.col("o_custkey") % 12).alias("tenure"),
    )


@register("""
SELECT 'unparseable date' AS rule, count(*) FILTER (o_orderpriority = '5-LOW') AS rows FROM orders
UNION ALL SELECT 'price out of range', count(*) FILTER (o_totalprice > 400000) FROM orders
UNION ALL SELECT 'unknown flag', count(*) FILTER (o_orderstatus = 'P') FROM orders""")
def violation_counts(spark, folder):
    """Several rules counted in one pass."""
    orders = table(spark, folder, "orders")
    day = F.when(
        F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    flag = F.translate("o_orderstatus", "FO", "tf")
    return quality.violations(
        orders,
        {
            "unparseable date": parsing.lost_date(day),
            "price out of range": parsing.out_of_range(F.col("o_totalprice"), upper=400_000),
            "unknown flag": parsing.unknown_flag(flag),
        },
    )


@register("""
SELECT p_partkey, CAST(CASE WHEN p_type = 'PROMO' THEN 0 ELSE 2 END AS INT) AS items,
  CASE WHEN p_type <> 'PROMO' THEN split_part(p_name, ' ', 1) END AS first_item,
  p_type = 'PROMO' AS unparseable
FROM part""")
def string_lists(spark, folder):
    """JSON arrays to lists; malformed text gives an empty list and is flagged."""
    text = F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(
        F.to_json(F.split("p_name", " "))
    )
    items = parsing.parse_string_list(text)
    return table(spark, folder, "part").select(
        "p_partkey",
        F.size(items).alias("items"),
        F.get(items, F.lit(0)).alias("first_item"),
        parsing.lost_list(text).alias("unparseable"),
    )


@register("""
SELECT p_partkey,
  CASE p_type WHEN 'SMALL' THEN 0.5 WHEN 'PROMO' THEN CAST(p_size AS DOUBLE)
    WHEN 'LARGE' THEN CAST(p_size AS DOUBLE) ELSE p_size / 2.0 END AS bathrooms,
  CASE p_type WHEN 'PROMO' THEN NULL ELSE p_type IN ('ECONOMY', 'SMALL') END AS shared
FROM part""")
def bathrooms(spark, folder):
    """Counts read from text, half baths, the numeric fallback and the shared flag."""
    kind, half = F.col("p_type"), (F.col("p_size") / 2.0).cast("string")
    text = (
        F.when(kind == "SMALL", "Shared half-bath")
        .when(kind == "PROMO", F.lit(None))
        .when(kind == "LARGE", "private bath")
        .when(kind == "ECONOMY", F.concat(half, F.lit(" shared baths")))
        .otherwise(F.concat(half, F.lit(" baths")))
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        parsing.bathroom_count(F.col("p_size"), text).alias("bathrooms"),
        parsing.bathroom_shared(text).alias("shared"),
    )


@register("""
SELECT p_partkey, lower(p_name) AS building FROM part""")
def building_types(spark, folder):
    """Occupancy prefixes stripped."""
    prefix = (
        F.when(F.col("p_type") == "PROMO", "Entire ")
        .when(F.col("p_type") == "SMALL", "Private room in ")
        .when(F.col("p_type") == "LARGE", " Room in  ")
        .otherwise("")
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        parsing.building_type(F.concat(prefix, F.initcap("p_name"))).alias("building"),
    )


@register("""
SELECT c_mktsegment, count(*) AS customers,
  count(*) FILTER (lat BETWEEN 37.1 AND 37.4 AND lon BETWEEN 23.05 AND 23.35) AS inside
FROM (SELECT c_mktsegment, 37.0 + ((c_custkey * 7919) % 10000) / 20000.0 AS lat,
    23.0 + ((c_custkey * 104729) % 10000) / 20000.0 AS lon FROM customer) GROUP BY ALL""")
def bounding_box_counts(spark, folder):
    """Rows inside an inclusive coordinate box."""
    placed = table(spark, folder, "customer").withColumns(spatial.point_columns(F.col("c_custkey")))
    box = parsing.within_box(F.col("latitude"), F.col("longitude"), 37.1, 37.4, 23.05, 23.35)
    return placed.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.count(F.when(box, 1)).alias("inside")
    )


@register("""
SELECT CASE WHEN p_size <= 2 THEN '1-2' WHEN p_size <= 4 THEN '3-4' WHEN p_size <= 7 THEN '5-7'
    ELSE '8+' END AS tier,
  CASE WHEN p_size <= 10 THEN '1-10' WHEN p_size <= 40 THEN '11-40' END AS band,
  count(*) AS parts
FROM part GROUP BY ALL""")
def capacity_tiers(spark, folder):
    """Right-closed bins; outside is null."""
    edges = (0, 10, 40)
    return table(spark, folder, "part").groupBy(
        bins.capacity_tier(F.col("p_size")).alias("tier"),
        bins.cut(F.col("p_size"), edges, bins.span_labels(edges)).alias("band"),
    ).agg(F.count(F.lit(1)).alias("parts"))


@register("""
SELECT c_custkey, """ + r_sql("""2 * 6371.0088 * asin(sqrt(pow(sin(radians(38.0 - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(38.0)) * pow(sin(radians(23.7 - lon) / 2), 2)))""") + """ AS km
FROM (SELECT c_custkey, 37.0 + ((c_custkey * 7919) % 10000) / 20000.0 AS lat,
    23.0 + ((c_custkey * 104729) % 10000) / 20000.0 AS lon FROM customer)""")
def haversine_distance(spark, folder):
    """Great-circle distance to a fixed point."""
    placed = table(spark, folder, "customer").withColumns(spatial.point_columns(F.col("c_custkey")))
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(38.0), F.lit(23.7))
    return placed.select("c_custkey", rnd(km).alias("km"))


@register("""
SELECT lang, count(*) AS documents,
  CAST(sum(greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS BIGINT) AS records
FROM documents GROUP BY ALL""")
def text_record_cost(spark, folder):
    """Billable records of whole documents, per language."""
    return sentiment.records_needed(table(spark, folder, "documents"), "text", ["lang"])


@register("""
SELECT doc_id, CAST(n AS INT) AS piece, length(substr(text, n * 5120 + 1, 5120)) AS kept, md5(substr(text, n * 5120 + 1, 5120)) AS digest
FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 5119) // 5120))) AS n FROM documents)""")
def truncated_documents(spark, folder):
    """Whole documents in pieces of the service's length limit."""
    pieces = table(spark, folder, "documents").select(
        "doc_id", F.posexplode(parsing.document_pieces(F.col("text"))).alias("piece", "cut")
    )
    return pieces.select(
        "doc_id", "piece", F.length("cut").cast("long").alias("kept"), F.md5("cut").alias("digest")
    )


@register("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""")
def first_per_key(spark, folder):
    """Duplicate keys reduced to their first row in an explicit order."""
    order = [F.col(c) for c in TIES if c not in ("l_orderkey", "l_linenumber")]
    kept = quality.drop_duplicates_keep_first(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], order
    )
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("""
WITH s AS (SELECT *, median(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linenumber) AS m
  FROM lineitem),
f AS (SELECT *, l_discount = 0 AND l_tax = 0 AS inactive, l_quantity > 45 AS long_term,
    l_discount >= 0.1 AS dormant, l_extendedprice > 1.9 * m AS extreme FROM s)
SELECT l_returnflag, count(*) AS n, count(*) FILTER (inactive) AS inactive,
  count(*) FILTER (long_term) AS long_term, count(*) FILTER (dormant) AS dormant,
  count(*) FILTER (extreme) AS extreme_price,
  count(*) FILTER (CAST(inactive AS INT) + CAST(long_term AS INT) + CAST(dormant AS INT)
    + CAST(extreme AS INT) > 1) AS multi_rule,
  count(*) FILTER (inactive OR long_term OR dormant OR extreme) AS removed,
  count(*) FILTER (NOT (inactive OR long_term OR dormant OR extreme)) AS kept
FROM f GROUP BY ALL""")
def filter_counts(spark, folder):
    """Independent removal rules with overlaps counted per market."""
    lines = filters.with_stratum_median(
        table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linenumber"]
    )
    _, counts = filters.apply_rules(
        lines,
        {
            "inactive": filters.is_inactive(F.col("l_discount"), F.lit(1.0)) & (F.col("l_tax") == 0),
            "long_term": filters.is_long_term(F.col("l_quantity"), 45),
            "dormant": filters.is_dormant(F.col("l_discount"), 0.1),
            "extreme_price": filters.is_extreme_price(
                F.col("l_extendedprice"), F.col("_stratum_median"), 1.9
            ),
        },
        ["l_returnflag"],
    )
    return counts


@register("""
SELECT l_suppkey, count(*) AS kept, """ + r_sql("sum(l_extendedprice)", 2) + """ AS total
FROM lineitem WHERE NOT (l_quantity > 45 OR l_discount >= 0.1) GROUP BY ALL""")
def filtered_rows(spark, folder):
    """Rows that no rule removes."""
    kept, _ = filters.apply_rules(
        table(spark, folder, "lineitem"),
        {
            "long_term": filters.is_long_term(F.col("l_quantity"), 45),
            "dormant": filters.is_dormant(F.col("l_discount"), 0.1),
        },
        ["l_returnflag"],
    )
    return kept.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("kept"), rnd(F.sum("l_extendedprice"), 2).alias("total")
    )


@register("""
SELECT user_id, count(*) AS days, max(d) - min(d) + 1 AS span,
  count(*) <> 30 OR max(d) - min(d) + 1 <> count(*) AS irregular
FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY ALL""")
def calendar_regularity(spark, folder):
    """Calendar rows and span per key."""
    days = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("d")).distinct()
    out = quality.calendar_regularity(days, "user_id", "d", expected=30)
    return out.withColumn("span", F.col("span").cast("long"))


@register("""
SELECT 'shipped before ordered' AS rule, count(*) FILTER (CAST(l_shipdate AS DATE)
    < CAST(o_orderdate AS DATE)) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'shipped long after', count(*) FILTER (CAST(l_shipdate AS DATE)
    > CAST(o_orderdate AS DATE) + 1000) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_order_rules(spark, folder):
    """Dates checked against another column of the same row."""
    joined = table(spark, folder, "lineitem", "l_orderkey", "l_shipdate").join(
        table(spark, folder, "orders", "o_orderkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    ship, order = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    return quality.violations(
        joined,
        {
            "shipped before ordered": parsing.out_of_range(ship, lower=order),
            "shipped long after": parsing.out_of_range(ship, upper=F.date_add(order, 1000)),
        },
    )


@register("""
SELECT l_partkey, count(DISTINCT l_returnflag) AS places FROM lineitem GROUP BY ALL
HAVING count(DISTINCT l_returnflag) > 1""")
def ids_across_markets(spark, folder):
    """Ids present in more than one market."""
    return quality.ids_in_several(table(spark, folder, "lineitem"), "l_partkey", "l_returnflag")


@register("""
SELECT l_orderkey, count(*) AS rows FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL""")
def orphan_keys(spark, folder):
    """Child keys without a parent, with affected rows."""
    parents = table(spark, folder, "orders").filter("o_orderstatus <> 'P'")
    return quality.orphans(table(spark, folder, "lineitem"), "l_orderkey", parents, "o_orderkey")


@register("""
SELECT count(*) AS rows, count(o_orderkey) AS resolved, count(*) - count(o_orderkey) AS orphan_rows,
  count(DISTINCT l_orderkey) - count(DISTINCT o_orderkey) AS orphan_keys,
  """ + r_sql("count(o_orderkey) / count(*)") + """ AS share
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o
  ON l_orderkey = o_orderkey""")
def join_integrity(spark, folder):
    """Share of child rows that find a parent."""
    parents = table(spark, folder, "orders").filter("o_orderstatus <> 'P'")
    out = quality.join_integrity(
        table(spark, folder, "lineitem"), "l_orderkey", parents, "o_orderkey"
    )
    return rounded(out, "share")


@register("""
SELECT o_custkey, count(*) AS orders FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL""")
def union_of_markets(spark, folder):
    """Union of per-market frames after a schema check."""
    orders = table(spark, folder, "orders")
    frames = {s: orders.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}
    return quality.union_checked(frames).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders")
    )


@register("""
SELECT l_suppkey, count(*) AS size FROM lineitem GROUP BY ALL""")
def group_sizes(spark, folder):
    """Rows per group."""
    return quality.group_sizes(table(spark, folder, "lineitem"), "l_suppkey")


@register("""
WITH p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos
  FROM orders)
SELECT o_orderpriority, count(*) AS size, max(pos) - min(pos) + 1 AS span FROM p GROUP BY ALL
HAVING count(*) <> max(pos) - min(pos) + 1""")
def group_run_check(spark, folder):
    """Groups that are not contiguous in a stored row order."""
    from rankloom.operators import ordering

    placed = ordering.group_rank(
        table(spark, folder, "orders", "o_orderpriority", "o_custkey", "o_orderkey"),
        [], [F.col("o_custkey"), F.col("o_orderkey")], "pos",
    )
    return quality.group_runs(placed, "o_orderpriority", "pos")


@register("""
SELECT min(l_linenumber) AS lowest, max(l_linenumber) AS highest,
  count(*) FILTER (l_linenumber <> floor(l_linenumber)) AS not_integral, count(l_linenumber) AS graded
FROM lineitem""")
def grade_range(spark, folder):
    """The facts behind the gain-vector check."""
    return quality.grade_range(table(spark, folder, "lineitem"), "l_linenumber")


@register("""
SELECT """ + TIES_SQL + """ FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem) WHERE n > 6""")
def informative_rows(spark, folder):
    """Rows of groups larger than the cut-off."""
    out = quality.informative_groups(table(spark, folder, "lineitem"), ["l_orderkey"], k=6)
    return out.select(*TIES)
