"""The engine's operators as queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import ArchiveConfig
from tidemark.functions import dates, hashing, names
from tidemark.operators import collisions, exact, filters, grouping, neardup, stats, tag_output, tags
from tidemark.plans.archive import plan_archive
from tidemark.sources import metadata
from tidemark.sources.band_index import BandIndex
from tidemark.sources.state_log import StateLog, rows_of
from tidemark.tables import fresh_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- exact duplicates -------------------------------------------------------------------------------------------------

_SIZE = "octet_length(encode(text))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text", F.octet_length(F.col("text").cast("binary")).cast("bigint").alias("size"))


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, size and digest of the documents, from one scan of the texts."""
    return exact.digest_table(_documents(spark, sf_dir), F.col("text"))


@query(f"SELECT {_SIZE} AS size, count(*) AS n FROM documents GROUP BY 1")
def size_histogram(spark, sf_dir):
    return exact.size_histogram(_documents(spark, sf_dir))


@query(f"SELECT doc_id, size, coalesce(count(*) OVER (PARTITION BY size) > 1 OR size IS NULL, true) AS is_candidate FROM (SELECT doc_id, {_SIZE} AS size FROM documents)")
def hash_candidates(spark, sf_dir):
    return exact.hash_candidates(_documents(spark, sf_dir).select("ord", "size")).select(F.col("ord").alias("doc_id"), "size", "is_candidate")


@query(f"""SELECT doc_id, size, CASE WHEN c > 1 THEN md5 END AS md5, coalesce(c > 1 AND rn > 1, false) AS is_duplicate FROM (
  SELECT doc_id, size, md5, count(*) OVER (PARTITION BY size) AS c, row_number() OVER (PARTITION BY size, md5 ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, {_SIZE} AS size, md5(text) AS md5 FROM documents))""")
def exact_dedup(spark, sf_dir):
    rows = exact.with_digest(exact.hash_candidates(_digests(spark, sf_dir)), F.col("digest"))
    return exact.first_wins(rows).select(F.col("ord").alias("doc_id"), "size", "md5", "is_duplicate")


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def full_hash_dedup(spark, sf_dir):
    return exact.dedup_all_hashes(_documents(spark, sf_dir), F.col("text")).select(F.col("ord").alias("doc_id"), "is_duplicate")


@query(f"SELECT size, list_sort(list(DISTINCT md5)) AS hashes FROM (SELECT {_SIZE} AS size, md5(text) AS md5 FROM documents) GROUP BY size")
def hashes_by_size(spark, sf_dir):
    rows = _documents(spark, sf_dir).withColumn("md5", hashing.md5_of(F.col("text")))
    return rows.select("size", "md5").distinct().groupBy("size").agg(F.sort_array(F.collect_list("md5")).alias("hashes"))


def _refill(old: DataFrame):
    """What fills in the hashes of archived rows: their digests."""
    digests = old.select(F.col("ord").alias("archived_path"), F.col("digest").alias("md5"))
    return lambda df: df.join(digests, "archived_path")


@query(f"""WITH d AS (SELECT doc_id, {_SIZE} AS size, md5(text) AS md5 FROM documents),
 a AS (SELECT * FROM d WHERE doc_id % 2 = 0), b AS (SELECT * FROM d WHERE doc_id % 2 = 1)
 SELECT doc_id, EXISTS (SELECT 1 FROM a WHERE a.size = b.size AND a.md5 = b.md5)
   OR row_number() OVER (PARTITION BY size, md5 ORDER BY doc_id) > 1 AS is_duplicate FROM b""")
def cross_batch_dedup(spark, sf_dir):
    """Odd documents against the state that the even ones left, with sizes never hashed filled in only where they recur."""
    docs = _digests(spark, sf_dir)
    old, new = docs.where("ord % 2 = 0"), docs.where("ord % 2 = 1")
    first = exact.with_digest(exact.hash_candidates(old), F.col("digest"))
    seen = first.where("md5 is not null").select("size", "md5").distinct()
    pending = first.where("hash_status = 'not_needed'").select("size", F.col("ord").alias("archived_path"))
    rows = exact.with_digest(exact.hash_candidates(new, first.select("size").distinct()), F.col("digest"))
    extra, _ = exact.backfill(pending, rows, _refill(old))
    return exact.first_wins(rows, seen.union(extra)).select(F.col("ord").alias("doc_id"), "is_duplicate")


@query(f"""WITH d AS (SELECT doc_id, {_SIZE} AS size FROM documents), a AS (SELECT size FROM d WHERE doc_id % 2 = 0 GROUP BY size HAVING count(*) = 1),
 b AS (SELECT DISTINCT size FROM d WHERE doc_id % 2 = 1) SELECT count(*) FILTER (WHERE b.size IS NOT NULL) AS filled, count(*) FILTER (WHERE b.size IS NULL) AS pending FROM a LEFT JOIN b USING (size)""")
def pending_ledger(spark, sf_dir):
    docs = _digests(spark, sf_dir)
    old, new = docs.where("ord % 2 = 0"), docs.where("ord % 2 = 1")
    first = exact.with_digest(exact.hash_candidates(old), F.col("digest"))
    pending = first.where("hash_status = 'not_needed'").select("size", F.col("ord").alias("archived_path"))
    rows = exact.with_digest(exact.hash_candidates(new, first.select("size").distinct()), F.col("digest"))
    filled, rest = exact.backfill(pending, rows, _refill(old))
    return filled.agg(F.count("*").alias("filled")).join(rest.agg(F.count("*").alias("pending")))  # one row by one row


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) p USING (o_orderkey)")
def resume_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return filters.not_processed(orders, orders.where("o_orderkey % 2 = 0"), "o_orderkey")


# --- near-duplicates --------------------------------------------------------------------------------------------------

#: Distance at which sign bits of the embeddings have neighbours.
NEAR = 20
_CODES = """codes AS (SELECT vec_id AS ord, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i::INT) ELSE 0 END))::HUGEINT AS h FROM embeddings)"""
_DIST = "(bit_count(a.h & 4294967295) * 0 + bit_count(xor(a.h::UBIGINT, b.h::UBIGINT)))::INT"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of the 64 components as one 64-bit pattern."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    code = F.aggregate(F.transform("embedding", bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), code.alias("code"))


@query(f"WITH {_CODES} SELECT a.ord AS ord_a, b.ord AS ord_b, bit_count(xor(a.h::UBIGINT, b.h::UBIGINT))::INT AS distance FROM codes a JOIN codes b ON a.ord < b.ord AND bit_count(xor(a.h::UBIGINT, b.h::UBIGINT)) <= {NEAR}")
def hamming_pairs(spark, sf_dir):
    return neardup.hamming_pairs(_codes(spark, sf_dir), NEAR)


_LEADERS = f"""RECURSIVE {_CODES}, seq AS (SELECT ord, h::UBIGINT AS h, row_number() OVER (ORDER BY ord) AS n FROM codes),
 fold(n, kept) AS (SELECT 0::BIGINT, []::UBIGINT[] UNION ALL
  SELECT s.n, CASE WHEN len(list_filter(f.kept, lambda k: bit_count(xor(k, s.h)) <= {NEAR})) = 0 THEN list_append(f.kept, s.h) ELSE f.kept END FROM fold f JOIN seq s ON s.n = f.n + 1),
 lead AS (SELECT s.ord, s.h, len(f.kept) > len(p.kept) AS is_leader FROM seq s JOIN fold f ON f.n = s.n JOIN fold p ON p.n = s.n - 1)"""


@query(f"WITH {_LEADERS} SELECT ord AS vec_id, is_leader FROM lead")
def near_dedup_leaders(spark, sf_dir):
    return neardup.leaders(_codes(spark, sf_dir), NEAR).select(F.col("ord").alias("vec_id"), "is_leader")


@query(f"""WITH {_LEADERS}, m AS (SELECT b.ord AS vec_id, a.ord AS leader, bit_count(xor(a.h, b.h))::INT AS distance FROM lead a JOIN lead b
  ON a.is_leader AND NOT b.is_leader AND a.ord < b.ord AND bit_count(xor(a.h, b.h)) <= {NEAR})
 SELECT vec_id, leader, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, leader) AS r FROM m) WHERE r = 1""")
def nearest_leader(spark, sf_dir):
    return neardup.nearest_leader(_codes(spark, sf_dir), NEAR).select(F.col("ord").alias("vec_id"), "leader", "distance")


#: Distances that the band join covers, without and with probes.
NEAR_BANDS, NEAR_PROBED = 7, 10
#: What sets the members of a family of four codes apart: 0, 2, 3 and 8 bits.
FLIPS = (0, 3, 28, 255 << 40)


def _family_sql(near: int) -> str:
    return f"""WITH {_CODES}, fam AS (SELECT b.ord, xor(o.h::UBIGINT, (CASE b.ord % 4 WHEN 0 THEN {FLIPS[0]} WHEN 1 THEN {FLIPS[1]} WHEN 2 THEN {FLIPS[2]} ELSE {FLIPS[3]} END)::UBIGINT) AS h
   FROM codes b JOIN codes o ON o.ord = b.ord - b.ord % 4)
 SELECT a.ord AS ord_a, b.ord AS ord_b, bit_count(xor(a.h, b.h))::INT AS distance FROM fam a JOIN fam b ON a.ord < b.ord AND bit_count(xor(a.h, b.h)) <= {near}"""


def _family_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of codes a few bits apart."""
    codes = _codes(spark, sf_dir)
    turn = F.col("ord") % 4
    flip = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in FLIPS)), (turn + 1).cast("int"))
    family = codes.select("ord", (F.col("ord") - turn).alias("first"), flip.alias("flip")).join(codes.select(F.col("ord").alias("first"), "code"), "first")
    return family.select("ord", F.col("code").bitwiseXOR(F.col("flip")).alias("code"))


@query(_family_sql(NEAR_BANDS))
def hamming_pairs_banded(spark, sf_dir):
    """Found by the band join."""
    return neardup.hamming_pairs(_family_codes(spark, sf_dir), NEAR_BANDS)


@query(_family_sql(NEAR_PROBED))
def hamming_pairs_probed(spark, sf_dir):
    """Found by bands that are at most one bit off on either side."""
    return neardup.hamming_pairs(_family_codes(spark, sf_dir), NEAR_PROBED)


_RUNS = f"""WITH RECURSIVE {_CODES}, fam AS (SELECT b.ord, xor(o.h::UBIGINT, (CASE b.ord % 4 WHEN 0 THEN {FLIPS[0]} WHEN 1 THEN {FLIPS[1]} WHEN 2 THEN {FLIPS[2]} ELSE {FLIPS[3]} END)::UBIGINT) AS h
   FROM codes b JOIN codes o ON o.ord = b.ord - b.ord % 4),
 seq AS (SELECT ord, h, (ord // 2 % 2)::INT AS run, row_number() OVER (ORDER BY ord // 2 % 2, ord) AS n FROM fam),
 fold(n, kept) AS (SELECT 0::BIGINT, []::UBIGINT[] UNION ALL
  SELECT s.n, CASE WHEN len(list_filter(f.kept, lambda k: bit_count(xor(k, s.h)) <= {{near}})) = 0 THEN list_append(f.kept, s.h) ELSE f.kept END FROM fold f JOIN seq s ON s.n = f.n + 1),
 lead AS (SELECT s.*, len(f.kept) > len(p.kept) AS is_leader FROM seq s JOIN fold f ON f.n = s.n JOIN fold p ON p.n = s.n - 1),
 best AS (SELECT b.ord, min(bit_count(xor(a.h, b.h))::INT * 1000000000000 + a.ord) AS m FROM lead a JOIN lead b ON a.is_leader AND a.run = 0 AND b.run = 1 AND bit_count(xor(a.h, b.h)) <= {{near}} GROUP BY 1)
 SELECT l.ord AS vec_id, run, is_leader, m % 1000000000000 AS earlier, (m // 1000000000000)::INT AS distance FROM lead l LEFT JOIN best USING (ord)"""


def _across_runs(spark: SparkSession, sf_dir: str, near: int) -> DataFrame:
    """The second of two runs finds leaders of the first in the index that the first one left."""
    rows = _family_codes(spark, sf_dir).withColumn("run", (F.floor(F.col("ord") / 2) % 2).cast("int"))
    index = BandIndex(spark, fresh_folder(spark, "band-index"), near)
    first = neardup.leaders(rows.where("run = 0"), near)
    index.append(first.where("is_leader").select("code", F.lpad(F.col("ord").cast("string"), 12, "0").alias("lead")), 0)
    found = index.near(rows.where("run = 1"), before=1)
    second = neardup.leaders(rows.where("run = 1"), near, known=found)
    every = first.union(second).join(found.withColumn("run", F.lit(1)), ["code", "run"], "left")
    return every.select(F.col("ord").alias("vec_id"), "run", "is_leader", F.col("leader").cast("bigint").alias("earlier"), "distance")


@query(_RUNS.format(near=NEAR_BANDS))
def leaders_across_runs(spark, sf_dir):
    return _across_runs(spark, sf_dir, NEAR_BANDS)


@query(_RUNS.format(near=NEAR_PROBED))
def leaders_across_runs_probed(spark, sf_dir):
    """Beyond the bands of one value each: the index is asked for values up to two bits off."""
    return _across_runs(spark, sf_dir, NEAR_PROBED)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(a, '[0-9A-Fa-f]{1,16}') AND regexp_full_match(b, '[0-9A-Fa-f]{1,16}')
   THEN bit_count(xor(('0x' || a)::UBIGINT, ('0x' || b)::UBIGINT))::INT ELSE 999 END AS distance FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'none' ELSE upper(to_hex(l_orderkey * 1234567)) END AS a, to_hex(l_partkey * 7654321 + l_linenumber) AS b FROM lineitem)""")
def hex_distance(spark, sf_dir):
    a = F.when(F.col("l_linenumber") == 3, "none").otherwise(F.hex(F.col("l_orderkey") * 1234567))
    b = F.hex(F.col("l_partkey") * 7654321 + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hashing.hamming(a, F.lower(b)).alias("distance"))


@query(f"WITH {_CODES}, q AS (SELECT h FROM codes WHERE ord = 0) SELECT ord AS vec_id, bit_count(xor(codes.h::UBIGINT, q.h::UBIGINT))::INT AS distance FROM codes, q WHERE bit_count(xor(codes.h::UBIGINT, q.h::UBIGINT)) <= 28")
def hamming_range_search(spark, sf_dir):
    codes = _codes(spark, sf_dir)
    one = codes.where("ord = 0").select(F.col("code").alias("q"))  # one row: the query
    return neardup.within(codes.join(F.broadcast(one)), F.col("q"), 28).select(F.col("ord").alias("vec_id"), "distance")


# --- names, bundles, placement ----------------------------------------------------------------------------------------

_NAME = "CASE WHEN n % 7 = 0 THEN '.' ELSE '' END || 'IMG_' || CASE WHEN n % 3 = 0 THEN 'E' ELSE '' END || (n // 4)::VARCHAR || CASE n % 5 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.mov' WHEN 2 THEN '.AAE' WHEN 3 THEN '.jpg' ELSE '.txt' END"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of files made of the parts table: bundles of four over a few folders."""
    n = F.col("p_partkey")
    ext = F.when(n % 5 == 0, ".HEIC").when(n % 5 == 1, ".mov").when(n % 5 == 2, ".AAE").when(n % 5 == 3, ".jpg").otherwise(".txt")
    quarter = F.floor(n / 4).cast("string")
    name = F.concat(F.when(n % 7 == 0, ".").otherwise(""), F.lit("IMG_"), F.when(n % 3 == 0, "E").otherwise(""), quarter, ext)
    folder = F.concat(F.lit("/photos/"), F.element_at(F.split("p_name", " "), 1))
    return table(spark, sf_dir, "part").select(n.alias("ord"), F.concat(folder, F.lit("/"), name).alias("path"), F.col("p_size").cast("bigint").alias("size"))


_ITEMS = f"items AS (SELECT n AS ord, '/photos/' || split_part(p_name, ' ', 1) || '/' || {_NAME} AS path, p_size::BIGINT AS size FROM (SELECT p_partkey AS n, p_name, p_size FROM part))"
_PARTS = r"regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir"
_EXT = r"regexp_extract(name, '^.+?(\.[^.]+)$', 1)"
_STEM = f"name[:length(name) - length({_EXT})]"
_NORM = rf"lower(regexp_replace({_STEM}, '^(IMG_)E(\d)', '\1\2', 'i'))"
_RANK = f"CASE WHEN lower({_EXT}) IN ({_quoted(config.IMAGE_EXTENSIONS)}) THEN 0 WHEN lower({_EXT}) IN ({_quoted(config.VIDEO_EXTENSIONS)}) THEN 1 ELSE 2 END"


@query(f"WITH {_ITEMS} SELECT path, name, dir, {_EXT} AS ext, {_STEM} AS stem, {_NORM} AS stem_key, lower(path) AS path_key, ({_RANK})::INT AS class_rank FROM (SELECT *, {_PARTS} FROM items)")
def normalize_names(spark, sf_dir):
    path = F.col("path")
    name = names.file_name(path)
    return _items(spark, sf_dir).select("path", name.alias("name"), names.parent(path).alias("dir"), names.suffix(name).alias("ext"), names.stem(name).alias("stem"), F.lower(names.normalize_stem(names.stem(name))).alias("stem_key"), names.path_key(path).alias("path_key"), names.class_rank(names.suffix(name)).alias("class_rank"))


@query(f"""WITH {_ITEMS} SELECT path FROM (SELECT path, {_PARTS} FROM items) WHERE NOT starts_with(name, '.') AND lower(name) NOT IN ({_quoted(config.SYSTEM_NAMES)})
  AND lower({_EXT}) IN ({_quoted(config.SUPPORTED_EXTENSIONS)}) AND NOT starts_with(path, '/photos/almond/')""")
def scan_filters(spark, sf_dir):
    items = filters.outside(filters.visible(_items(spark, sf_dir)), ["/photos/almond"])
    return filters.supported(items).select("path")


@query(rf"WITH {_ITEMS} SELECT path FROM items WHERE lower(regexp_extract(path, '^.*\.(.+)$', 1)) IN ('jpg', 'heic')")
def extension_filter(spark, sf_dir):
    return filters.by_extension(_items(spark, sf_dir), accept=["JPG", "heic"], reject=["mov"]).select("path")


@query(f"""WITH {_ITEMS}, m AS (SELECT ord, path, dir, {_NORM} AS stem_key, {_RANK} AS r FROM (SELECT *, {_PARTS} FROM items))
 SELECT dir, stem_key, arg_min(path, r * 1000000000 + ord) AS primary_path, list(path ORDER BY r, ord)[2:] AS companions, min(ord) AS group_ord, count(*)::INT AS members FROM m GROUP BY dir, stem_key""")
def group_primary(spark, sf_dir):
    out = grouping.group_files(_items(spark, sf_dir))
    return out.select("dir", "stem_key", F.col("primary.path").alias("primary_path"), F.transform("companions", lambda c: c["path"]).alias("companions"), "group_ord", "members")


@query("""SELECT page_id, host, min(page_id) OVER (PARTITION BY host) AS primary_id, CASE WHEN page_id = min(page_id) OVER (PARTITION BY host) THEN 'primary' ELSE 'companion' END AS role, count(*) OVER (PARTITION BY host) AS members
 FROM (SELECT page_id, regexp_replace(url, '[^/]*$', '') AS host FROM pages)""")
def page_bundles(spark, sf_dir):
    """The bundling operator over other items: pages that share a folder of their address."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[^/]*$", "").alias("host"))
    return grouping.elected(pages, ["host"], F.lit(0), "page_id").select("page_id", "host", F.col("primary_ord").alias("primary_id"), "role", "members")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month FROM orders")
def archive_year_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.year_folder(F.col("o_orderdate")).alias("year"), dates.month_folder(F.col("o_orderdate")).alias("month"))


@query("SELECT strftime(o_orderdate, '%Y/%m') AS folder, count(*) AS n, sum(o_totalprice)::DECIMAL(38,2) AS total FROM (SELECT o_orderdate, o_totalprice::DECIMAL(18,2) AS o_totalprice FROM orders) GROUP BY 1")
def archive_partitions(spark, sf_dir):
    day = F.col("o_orderdate")
    folder = F.concat(dates.year_folder(day), F.lit("/"), dates.month_folder(day))
    return table(spark, sf_dir, "orders").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


@query("""SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, source, key FROM (SELECT o_orderkey,
  coalesce(try_strptime(a[:19], '%Y:%m:%d %H:%M:%S'), try_strptime(b[:19], '%Y:%m:%d %H:%M:%S'), o_orderdate) AS t,
  CASE WHEN coalesce(try_strptime(a[:19], '%Y:%m:%d %H:%M:%S'), try_strptime(b[:19], '%Y:%m:%d %H:%M:%S')) IS NULL THEN 'mtime' ELSE 'exiftool' END AS source,
  CASE WHEN try_strptime(a[:19], '%Y:%m:%d %H:%M:%S') IS NOT NULL THEN 'EXIF:DateTimeOriginal' WHEN try_strptime(b[:19], '%Y:%m:%d %H:%M:%S') IS NOT NULL THEN 'QuickTime:CreateDate' END AS key
  FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') || '+08:00' WHEN 1 THEN '0000:00:00 00:00:00' WHEN 2 THEN '' END AS a,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y:%m:%d %H:%M:%S') ELSE 'none' END AS b FROM orders))""")
def date_coalesce_provenance(spark, sf_dir):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey")
    form = "yyyy:MM:dd HH:mm:ss"
    a = F.when(k % 4 == 0, F.concat(F.date_format(day, form), F.lit("+08:00"))).when(k % 4 == 1, "0000:00:00 00:00:00").when(k % 4 == 2, "")
    b = F.when(k % 3 == 0, F.date_format(day + F.expr("INTERVAL 1 DAY"), form)).otherwise("none")
    meta = F.create_map(F.lit("EXIF:DateTimeOriginal"), a, F.lit("QuickTime:CreateDate"), b, F.lit("File:FileModifyDate"), F.date_format(day, form))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("mtime"), meta.alias("meta"))
    rows = rows.withColumns({"t": dates.resolve_time(F.col("meta"), F.col("mtime")), "key": dates.capture_key(F.col("meta"))})
    return rows.select("o_orderkey", F.date_format("t.time", "yyyy-MM-dd HH:mm:ss").alias("time"), "t.source", "key")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS ord, replace(p_name, ' ', '_') || '.jpg' AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
 SELECT ord AS p_partkey, CASE WHEN n = 1 THEN name ELSE replace(name, '.jpg', '_' || (n - 1) || '.jpg') END AS final_name FROM p""")
def collision_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.lit("/archive").alias("folder"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpg")).alias("name"))
    return collisions.unique_names(rows).select(F.col("ord").alias("p_partkey"), "final_name")


_CHAINS = """s AS (SELECT p_partkey AS ord, replace(p_name, ' ', '_') AS stem, replace(p_name, ' ', '_') || CASE p_partkey % 4 WHEN 0 THEN '_1' WHEN 1 THEN '_1_1' ELSE '' END AS own FROM part)"""


@query(f"""WITH RECURSIVE {_CHAINS}, seq AS (SELECT ord, stem, own, row_number() OVER (PARTITION BY stem ORDER BY ord) AS n FROM s),
 fold(stem, n, ord, given, taken) AS (SELECT DISTINCT stem, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, [stem || '_2.jpg'] FROM s UNION ALL
  SELECT stem, n, ord, given, list_append(taken, given) FROM (SELECT q.stem, q.n, q.ord, f.taken, list_filter([q.own || '.jpg'] || list_transform(range(1, len(f.taken) + 2), lambda k: q.own || '_' || k || '.jpg'), lambda c: NOT list_contains(f.taken, c))[1] AS given
   FROM fold f JOIN seq q ON q.stem = f.stem AND q.n = f.n + 1))
 SELECT ord AS p_partkey, given AS final_name FROM fold WHERE n > 0""")
def collision_families(spark, sf_dir):
    """Names that meet the copies of others, and files that are there: families that want several names."""
    n = F.col("p_partkey")
    stem = F.replace("p_name", F.lit(" "), F.lit("_"))
    own = F.concat(stem, F.when(n % 4 == 0, "_1").when(n % 4 == 1, "_1_1").otherwise(""), F.lit(".jpg"))
    rows = table(spark, sf_dir, "part").select(n.alias("ord"), F.lit("/archive").alias("folder"), own.alias("name"))
    there = table(spark, sf_dir, "part").select(F.lit("/archive").alias("folder"), F.concat(stem, F.lit("_2.jpg")).alias("name"))
    return collisions.unique_names(rows, existing=there).select(F.col("ord").alias("p_partkey"), "final_name")


def _copies_sql(text: str, taken: str, first: str, end: str = ".jpg") -> str:
    """The m-th number that is missing among the taken ones, by a list of all."""
    return f"""WITH s AS (SELECT p_partkey, p_size, replace(p_name, ' ', '_') AS stem FROM part),
 t AS (SELECT stem, list(DISTINCT k) AS taken FROM (SELECT stem, {taken} AS k FROM s WHERE p_partkey % 4 = 0) GROUP BY stem),
 r AS (SELECT p_partkey, stem, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS m, count(*) OVER (PARTITION BY stem) AS n FROM s),
 k AS (SELECT p_partkey, r.stem, list_filter(range(0, n + 60), lambda x: NOT list_contains(coalesce(taken, []), x))[m] AS k FROM r LEFT JOIN t USING (stem))
 SELECT p_partkey, '/out/' || stem || CASE WHEN k = 0 THEN '{first}' ELSE {text} END || '{end}' AS name FROM k"""


def _copy_numbers(spark: SparkSession, sf_dir: str, template: str, taken: Column, end: str = ".jpg") -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("/in/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpg")).alias("path"))
    _, how, _ = collisions.numbering(template)
    stem = F.concat(names.stem(names.file_name(F.col("path"))))
    there = parts.where("p_partkey % 4 = 0").select(F.lit("/out").alias("folder"), F.concat(stem, how.column(taken), F.lit(end)).alias("name"))
    return tags.unused_names(parts, "/out/" + template, "path", "p_partkey", there).select("p_partkey", "name")


@query(_copies_sql("'-' || lpad((k + 1)::VARCHAR, 2, '0')", "p_size % 9", ""))
def copy_numbers(spark, sf_dir):
    """Copy numbers with holes: a dash and two digits, from 02 on, where some are taken. The SQL says the same up to 99; it cuts 100 to 10."""
    return _copy_numbers(spark, sf_dir, "%f%-2nc.%e", F.col("p_size") % 9)


@query(_copies_sql("'_' || CASE WHEN k < 26 THEN '' ELSE chr((64 + k // 26)::INT) END || chr((65 + k % 26)::INT)", "p_size % 50", "_A"))
def copy_letters(spark, sf_dir):
    """Copies by capital letters, the first name's too. The SQL has two letters: it says the same up to copy 701, ZZ."""
    return _copy_numbers(spark, sf_dir, "%f%+.uc.%e", F.col("p_size") % 50)


@query(_copies_sql("'-' || chr((65 + i // 676)::INT) || chr((65 + i // 26 % 26)::INT) || chr((65 + i % 26)::INT)", "p_size % 50", "", " copy.jpg").replace("m] AS k FROM r", "m] AS k, CASE WHEN k = 26 THEN 0 WHEN k < 26 THEN k ELSE k - 1 END AS i FROM r"))
def copy_letters_filled(spark, sf_dir):
    """Copies by three letters within a name, the first name without any."""
    return _copy_numbers(spark, sf_dir, "%f%-3uc copy.%e", F.col("p_size") % 50, " copy.jpg")


@query("""SELECT p_partkey, '/out/' || printf('%06d', 99 + row_number() OVER (ORDER BY p_partkey)) || '-' || printf('%03d', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) || '_' || replace(p_name, ' ', '_') || '.jpg' AS name FROM part""")
def sequence_names(spark, sf_dir):
    """Names by place: among all files from 100 on, and within the folder from 1 on."""
    path = F.concat(F.lit("/in/"), F.col("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpg"))
    parts = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return tags.sequence_names(parts, "/out/%100.6C-%-.3nC_%f.%e", "path", "p_partkey").select("p_partkey", "name")


# --- whole plan, statistics, state ------------------------------------------------------------------------------------


def _document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the bundle-free kind: a name per document, its text as content, a day by its id as mtime."""
    ext = F.when(F.col("doc_id") % 10 == 9, ".txt").otherwise(".jpg")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), ext).alias("path"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("ord"),
        F.octet_length(F.col("text").cast("binary")).cast("bigint").alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 700 * 86400).alias("mtime"),
        F.col("text").cast("binary").alias("content"),
    )


def _document_plan(spark: SparkSession, sf_dir: str):
    return plan_archive(_document_items(spark, sf_dir), ArchiveConfig("/archive", "/duplicates"))


_PLAN = f"""d AS (SELECT doc_id, '/in/' || source || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.jpg' AS path, lpad(doc_id::VARCHAR, 12, '0') || '.jpg' AS name,
  to_timestamp(1704067200 + doc_id % 700 * 86400) AT TIME ZONE 'UTC' AS t, row_number() OVER (PARTITION BY {_SIZE}, md5(text) ORDER BY doc_id) > 1 AS dup FROM documents WHERE doc_id % 10 <> 9)"""


@query(f"WITH {_PLAN} SELECT path, CASE WHEN dup THEN 'duplicate' ELSE 'archive' END AS action, CASE WHEN dup THEN '/duplicates/' ELSE strftime(t, '/archive/%Y/%m/') END || name AS destination FROM d")
def archive_plan(spark, sf_dir):
    return _document_plan(spark, sf_dir).rows.select("path", "action", "destination")


def _bundle_plan(spark: SparkSession, sf_dir: str):
    """Bundles of files with sidecars and companions, some without a size or a time, in a layout by type."""
    n = F.col("ord")
    items = _items(spark, sf_dir).select(
        "path",
        "ord",
        F.when(n % 13 != 0, F.col("size")).alias("size"),
        F.when(n % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + n % 700 * 86400)).alias("mtime"),
        F.concat(F.lit("c"), (F.floor(n / 4) % 50).cast("string")).cast("binary").alias("content"),
    )
    return plan_archive(items, ArchiveConfig("/archive", "/duplicates", by_type=True))


_BUNDLES = f"""{_ITEMS}, f AS (SELECT ord, path, dir, {_NORM} AS stem_key, lower({_EXT}) AS ext, {_RANK} AS r, CASE WHEN ord % 13 <> 0 THEN size END AS size,
   CASE WHEN ord % 11 <> 0 THEN to_timestamp(1704067200 + ord % 700 * 86400) AT TIME ZONE 'UTC' END AS t, 'c' || (ord // 4) % 50 AS content FROM (SELECT *, {_PARTS} FROM items)),
 m AS (SELECT *, row_number() OVER (PARTITION BY dir, stem_key ORDER BY r, ord) AS turn FROM f WHERE ext IN ({_quoted(config.SUPPORTED_EXTENSIONS)})),
 lead AS (SELECT *, CASE WHEN size IS NULL THEN 'ERROR' WHEN row_number() OVER (PARTITION BY size IS NULL, size, content ORDER BY ord) > 1 THEN 'duplicate' WHEN t IS NULL THEN 'FAIL' ELSE 'archive' END AS fate FROM m WHERE turn = 1),
 every AS (SELECT m.*, lead.fate, lead.t AS lead_t FROM m JOIN lead USING (dir, stem_key))"""
_COUNTS = f"""SELECT (SELECT count(*) FROM f) AS scanned, count(*) FILTER (WHERE turn = 1 AND fate = 'archive') AS moved, count(*) FILTER (WHERE turn = 1 AND fate = 'duplicate') AS duplicates, 0::BIGINT AS visual_duplicates,
  count(*) FILTER (WHERE turn > 1 AND fate = 'archive' AND ext = '.aae') AS sidecars_paired, count(*) FILTER (WHERE turn > 1 AND fate = 'archive' AND ext <> '.aae') AS livephotos_paired,
  (SELECT count(*) FROM f WHERE ext NOT IN ({_quoted(config.SUPPORTED_EXTENSIONS)})) AS skipped, 0::BIGINT AS resumed, count(*) FILTER (WHERE turn = 1 AND fate = 'archive') AS date_from_mtime,
  count(*) FILTER (WHERE turn = 1 AND fate = 'FAIL') AS failed, count(*) FILTER (WHERE turn = 1 AND fate = 'ERROR') AS errored FROM every"""


@query(f"WITH {_BUNDLES} {_COUNTS}")
def archive_stats(spark, sf_dir):
    return _bundle_plan(spark, sf_dir).counters


@query(f"WITH {_BUNDLES} SELECT CASE WHEN errored > 0 THEN 2 WHEN failed > 0 THEN 1 ELSE 0 END AS exit_code FROM ({_COUNTS})")
def archive_exit_code(spark, sf_dir):
    return _bundle_plan(spark, sf_dir).exit_code()


@query(f"""WITH {_BUNDLES} SELECT path, CASE fate WHEN 'archive' THEN strftime(lead_t, '/archive/%Y/%m/') || CASE WHEN r = 0 THEN 'images' WHEN r = 1 THEN 'videos' WHEN ext = '.aae' THEN 'aae' ELSE 'others' END
  WHEN 'duplicate' THEN '/duplicates' END AS folder FROM every""")
def archive_by_type(spark, sf_dir):
    return _bundle_plan(spark, sf_dir).rows.select("path", "folder")


@query(f"SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT {_SIZE} AS size FROM documents)")
def archive_estimate(spark, sf_dir):
    return stats.estimate(_documents(spark, sf_dir))


@query(f"SELECT count(DISTINCT size) AS sizes, count(*) AS hashes, (SELECT count(*) FROM documents) AS paths FROM (SELECT DISTINCT {_SIZE} AS size, md5(text) FROM documents)")
def history_totals(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("md5", hashing.md5_of(F.col("text")))
    return stats.history_totals(docs.select("size", "md5").distinct(), docs.select("ord"))


@query(f"SELECT DISTINCT {_SIZE} AS size, md5(text) AS md5 FROM documents")
def state_round_trip(spark, sf_dir):
    """Hashes of a state that two runs committed to its log."""
    docs = _documents(spark, sf_dir).select("ord", "size", hashing.md5_of(F.col("text")).alias("md5"))
    kept = StateLog(spark, fresh_folder(spark, "state-log"))
    for run in (0, 1):
        own = docs.where(F.col("ord") % 2 == run)
        kept.commit(rows_of("hash", own, "size", "md5").union(rows_of("path", own, None, "ord")))
    return kept.state().seen


# --- queries over tags ------------------------------------------------------------------------------------------------


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    meta = F.map_concat(tags.from_json_object(F.col("props")), F.create_map(F.lit("Event:Type"), F.col("event_type"), F.lit("Event:User"), F.col("user_id").cast("string")))
    return events.select("event_id", meta.alias("meta"))


@query("SELECT event_id::VARCHAR AS \"SourceFile\", event_type AS \"Event:Type\", user_id::VARCHAR AS \"Event:User\", coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def tag_table_union(spark, sf_dir):
    """A column for every tag that any item has, found first."""
    return tags.spread_all(_tagged(spark, sf_dir), "meta", "event_id")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, '== ' || o_orderstatus AS sect, '-- ' || o_orderkey || ' ' || o_orderpriority AS ends, o_orderkey % 3 <> 0 AS shown,
   lag(o_orderstatus) OVER w AS before, lag(o_orderkey) OVER w AS prev, lag(o_orderpriority) OVER w AS prev_p, lead(o_orderkey) OVER w IS NULL AS final, o_orderstatus AS s FROM orders WINDOW w AS (ORDER BY o_orderkey))
 SELECT k AS o_orderkey, 0 AS seq, 'from ' || k AS line FROM o WHERE prev IS NULL UNION ALL SELECT k, 1, '-- ' || prev || ' ' || prev_p FROM o WHERE before <> s
 UNION ALL SELECT k, 2, sect FROM o WHERE prev IS NULL OR before <> s UNION ALL SELECT k, 3, k || ': ' || p FROM o WHERE shown
 UNION ALL SELECT k, 4, ends FROM o WHERE final UNION ALL SELECT k, 5, 'to ' || k FROM o WHERE final""")
def tag_sections(spark, sf_dir):
    """A report with a section on each change of status, across partitions."""
    key = F.col("o_orderkey").cast("string")
    meta = F.map_filter(F.create_map(F.lit("Key"), key, F.lit("Priority"), F.col("o_orderpriority"), F.lit("Status"), F.col("o_orderstatus"), F.lit("Shown"), F.when(F.col("o_orderkey") % 3 != 0, "1")), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "orders").select("o_orderkey", meta.alias("meta"))
    return tags.sections(rows, "meta", "o_orderkey", "${Key}: $Priority", "from $Key", "== $Status", ["Shown"], "-- $Key $Priority", "to $Key")


@query("SELECT event_id, event_type AS type, json_extract_string(props, '$.k') AS k FROM events WHERE coalesce(json_extract_string(props, '$.k')::INT > 50, false) AND event_type <> 'view'")
def tag_filter(spark, sf_dir):
    rows = filters.holds(_tagged(spark, sf_dir), "try_cast(meta['k'] AS INT) > 50", "meta['Event:Type'] <> 'view'")
    return rows.select("event_id", F.col("meta")["Event:Type"].alias("type"), F.col("meta")["k"].alias("k"))


@query("SELECT event_id::VARCHAR AS \"SourceFile\", event_type AS \"Event:Type\", user_id::VARCHAR AS \"Event:User\", coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def tag_table(spark, sf_dir):
    return tags.spread(_tagged(spark, sf_dir), "meta", "event_id", ["Event:Type", "Event:User", "k"])


@query("SELECT event_id, row_number() OVER (ORDER BY event_type DESC, try_cast(json_extract_string(props, '$.k') AS DOUBLE), event_id) AS place FROM events QUALIFY place <= 100")
def tag_sort_top(spark, sf_dir):
    """The first hundred by type (descending) and k: a top-k report."""
    top = tags.sort_by(_tagged(spark, sf_dir), "meta", ["-Event:Type", "k"], "event_id").limit(100)
    from pyspark.sql import Window

    keys = [*tags.natural_order(F.col("meta")["Event:Type"], True), *tags.natural_order(F.col("meta")["k"]), F.col("event_id")]
    return top.select("event_id", F.row_number().over(Window.orderBy(*keys)).cast("bigint").alias("place"))  # of a hundred rows


@query("SELECT event_id, 'Event:Type' AS tag FROM events UNION ALL SELECT event_id, 'Event:User' FROM events")
def tag_projection(spark, sf_dir):
    kept = tags.project(F.col("meta"), keep=["Event:Type", "user", "k"], drop=["k"])
    return _tagged(spark, sf_dir).select("event_id", F.explode(F.map_keys(kept)).alias("tag"))


@query("""WITH t AS (SELECT user_id, arg_max(event_type, event_id) AS a, arg_min(event_type, event_id) AS b FROM events GROUP BY user_id)
 SELECT user_id::VARCHAR AS tag, a AS left_value, b AS right_value FROM t WHERE a <> b""")
def tag_difference(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("tag"), "event_id", "event_type")
    left = events.groupBy("tag").agg(F.max_by("event_type", "event_id"))
    right = events.groupBy("tag").agg(F.min_by("event_type", "event_id"))
    return tags.difference(left, right)


@query("SELECT event_id, event_type || ' by ' || user_id || ' $' || coalesce(json_extract_string(props, '$.k'), '-') AS line FROM events")
def tag_print_format(spark, sf_dir):
    return _tagged(spark, sf_dir).select("event_id", tags.print_format("${Event:Type} by ${Event:User} $$$k", F.col("meta")).alias("line"))


@query("""SELECT event_id, '{"Event:Type":"' || event_type || '","Event:User":' || user_id || CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '' ELSE ',"k":' || json_extract_string(props, '$.k') END || '}' AS json FROM events""")
def tag_json(spark, sf_dir):
    return _tagged(spark, sf_dir).select("event_id", tags.to_json_object(tags.project(F.col("meta"), keep=["Event:Type", "Event:User", "k"])).alias("json"))


@query("SELECT e.event_id, e.event_type, c.c_name AS name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def tag_import(spark, sf_dir):
    """Values of another table joined to items by their name."""
    values = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("SourceFile"), F.col("c_name").alias("name"))
    return tags.attach(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), values, "user_id").select("event_id", "event_type", "name")


@query("SELECT lower(replace(json_extract_string(j, '$.SourceFile'), chr(92), '/')) AS path_key, json_extract_string(j, '$.Type') AS type FROM (SELECT json_object('SourceFile', 'C:' || chr(92) || 'In' || chr(92) || event_id, 'Type', event_type) AS j FROM events)")
def metadata_records(spark, sf_dir):
    """A metadata reader's JSON records as path keys and tag maps."""
    doc = F.to_json(F.struct(F.concat(F.lit("C:\\In\\"), F.col("event_id").cast("string")).alias("SourceFile"), F.col("event_type").alias("Type")))
    records = metadata.from_records(table(spark, sf_dir, "events").select(doc.alias("value")))
    return records.select("path_key", F.col("meta")["Type"].alias("type"))


@query(f"WITH {_ITEMS} SELECT path FROM items WHERE len(list_filter(string_split(path, '/')[:-2], lambda x: x IN ('almond', 'blue'))) = 0")
def ignored_folders(spark, sf_dir):
    return filters.not_ignored(_items(spark, sf_dir), ["almond", "blue"], hidden=True).select("path")


@query(f"WITH {_ITEMS} SELECT path, '/out' || dir || '/' || {_STEM} || '_' || ltrim({_EXT}, '.') || '%.txt' AS name FROM (SELECT *, {_PARTS} FROM items)")
def output_names(spark, sf_dir):
    return _items(spark, sf_dir).select("path", tags.output_name("/out%d%f_%e%%.txt", F.col("path")).alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day, o_orderstatus AS status FROM orders")
def tag_dates(spark, sf_dir):
    meta = F.create_map(F.lit("Date"), F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.lit("Status"), F.col("o_orderstatus"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", tags.format_dates(meta, "yyyy-MM-dd HH:mm").alias("meta"))
    return out.select("o_orderkey", F.col("meta")["Date"].alias("day"), F.col("meta")["Status"].alias("status"))


@query("SELECT event_id, event_type || chr(9) || user_id || coalesce(chr(9) || json_extract_string(props, '$.k'), '') AS line FROM events")
def tag_lines(spark, sf_dir):
    kept = tags.project(F.col("meta"), keep=["Event:Type", "Event:User", "k"])
    return _tagged(spark, sf_dir).select("event_id", tags.sorted_lines(kept).alias("line"))


@query("SELECT event_id, 'Item:Type' AS tag FROM events UNION ALL SELECT event_id, 'Item:Id' FROM events")
def tag_groups(spark, sf_dir):
    meta = F.create_map(F.lit("Type"), F.col("event_type"), F.lit("Id"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.map_keys(tags.with_group(meta, F.lit("Item")))).alias("tag"))


@query("SELECT p_partkey, array_to_string(w, ' + ') AS joined, w[-1] AS last, w[2] AS second, NULL::VARCHAR AS far FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def tag_lists(spark, sf_dir):
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", tags.list_join(w, " + ").alias("joined"), tags.list_item(w, -1).alias("last"), tags.list_item(w, 1).alias("second"), tags.list_item(w, 99).alias("far"))


@query("""SELECT o_orderpriority, CASE WHEN count(*) FILTER (WHERE o_totalprice > 500000) > 0 THEN 1 WHEN count(*) FILTER (WHERE o_orderstatus <> 'X') > 0 THEN 2 ELSE 0 END AS status FROM orders GROUP BY 1""")
def tag_exit_status(spark, sf_dir):
    """Of each priority: orders beyond a price count as errors, and no order meets the condition."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 500000).alias("errors"), F.count_if(F.col("o_orderstatus") == "X").alias("passed"), F.count_if(F.col("o_orderstatus") != "X").alias("failed"))
    return tags.exit_status(counts, "o_orderpriority")


@query("""WITH p AS (SELECT p_partkey, p_brand AS b, p_name AS n, p_size::VARCHAR AS s, p_type AS t, string_split(p_name, ' ') AS w FROM part)
 SELECT p_partkey, '{"Brand":' || to_json(b)::VARCHAR || ',"Item":{".":' || to_json(n)::VARCHAR || ',"Size":' || s || ',"Type":' || to_json(t)::VARCHAR || ',"Word":[' || array_to_string(list_transform(w, lambda x: to_json(x)::VARCHAR), ',') || ']}}' AS json,
   'Array("Brand" => "' || b || '","Item" => Array("." => "' || n || '","Size" => ' || s || ',"Type" => "' || t || '","Word" => Array("' || array_to_string(w, '","') || '")))' AS php,
   '<rdf:Description rdf:about=''part/' || p_partkey || '''><Brand>' || b || '</Brand><Item rdf:parseType=''Resource''><_.>' || n || '</_.><Size>' || s || '</Size><Type>' || t || '</Type><Word><rdf:Bag><rdf:li>' || array_to_string(w, '</rdf:li><rdf:li>') || '</rdf:li></rdf:Bag></Word></Item></rdf:Description>' AS xml FROM p""")
def tag_struct(spark, sf_dir):
    """Flat tag paths as trees: members, a list, and a value that has members beside it."""
    words = F.split("p_name", " ")
    plain = F.create_map(F.lit("Item.Type"), F.col("p_type"), F.lit("Brand"), F.col("p_brand"), F.lit("Item"), F.col("p_name"), F.lit("Item.Size"), F.col("p_size").cast("string"))
    listed = F.map_from_entries(F.transform(words, lambda w, i: F.struct(F.concat(F.lit("Item.Word["), i.cast("string"), F.lit("]")), w)))
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", tag_output.entries(F.map_concat(listed, plain)).alias("tree"))
    about = F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", tag_output.written(F.col("tree")).alias("json"), tag_output.written(F.col("tree"), tag_output.PHP).alias("php"), tag_output.described(tag_output.written(F.col("tree"), tag_output.XML), about).alias("xml"))


@query("""WITH e AS (SELECT event_id, event_type AS t, user_id::VARCHAR AS u, json_extract_string(props, '$.k') AS k FROM events)
 SELECT event_id, '<table><tr><td>Event:Type</td><td>' || t || '</td></tr><tr><td>Event:User</td><td>' || u || '</td></tr>' || coalesce('<tr><td>k</td><td>' || k || '</td></tr>', '') || '</table>' AS html,
   'Event:Type' || chr(9) || t || chr(10) || 'Event:User' || chr(9) || u || coalesce(chr(10) || 'k' || chr(9) || k, '') AS tabs FROM e""")
def tag_tables_as_text(spark, sf_dir):
    kept = tags.project(F.col("meta"), keep=["Event:Type", "Event:User", "k"])
    return _tagged(spark, sf_dir).select("event_id", tag_output.html_table(kept).alias("html"), tag_output.tab_table(kept).alias("tabs"))
