"""Queries over the driver's tables, with the same query in DuckDB SQL.

``documents`` stand for the files of volumes (volume = lang, folder = source, name = doc<id>, content = the text's
UTF-8 bytes), ``part`` for named entries in folders (p_brand), ``pages`` for raw bytes, ``events`` for dates and
``region`` > ``nation`` > ``customer`` for a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sectorlake.functions import binary as b, encode, formats as f
from sectorlake.operators import catalogue, detect
from sectorlake.plans.prefix import SPAN, ranked, running_sum
from sectorlake.sources.images import CYLINDER, TRACK, cut_sectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content() -> Column:
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8")


HASH_SQL = "list_reduce(list_prepend(CAST(length(p_name) AS BIGINT), list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(substr(upper(p_name), i, 1)) AS BIGINT))), lambda h, c: (h * 13 + c) & 2047) % 72"


@query(f"SELECT p_partkey, p_name, {HASH_SQL} AS bucket FROM part")
def name_hash_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", b.name_hash(F.col("p_name")).alias("bucket"))


@query(f"""
    WITH h AS (SELECT p_partkey, p_brand, {HASH_SQL} AS bucket FROM part)
    SELECT p_partkey, p_brand, bucket, coalesce(lag(p_partkey) OVER w, 0) AS linked_partkey, CAST(lead(p_partkey) OVER w IS NULL AS INTEGER) AS is_head
    FROM h WINDOW w AS (PARTITION BY p_brand, bucket ORDER BY p_partkey)""")
def hash_chain_links(spark, sf_dir):
    """Entries are put in front of their bucket's chain in key order."""
    w = Window.partitionBy("p_brand", "bucket").orderBy("p_partkey")
    h = table(spark, sf_dir, "part").select("p_partkey", "p_brand", b.name_hash(F.col("p_name")).alias("bucket"))
    return h.select("*", F.coalesce(F.lag("p_partkey").over(w), F.lit(0)).alias("linked_partkey"), F.lead("p_partkey").over(w).isNull().cast("int").alias("is_head"))


@query(f"SELECT p_brand, bucket, count(*) AS entries, count(*) - 1 AS collisions FROM (SELECT p_brand, {HASH_SQL} AS bucket FROM part) GROUP BY ALL")
def bucket_load(spark, sf_dir):
    h = table(spark, sf_dir, "part").select("p_brand", b.name_hash(F.col("p_name")).alias("bucket"))
    return h.groupBy("p_brand", "bucket").agg(F.count("*").alias("entries"), (F.count("*") - 1).alias("collisions"))


def _blocks(docs: DataFrame, payload: int) -> DataFrame:
    n = F.ceil(F.octet_length("content") / payload).cast("int")
    held = docs.select("doc_id", content().alias("content")).where(F.octet_length("content") > 0)
    return held.select("doc_id", F.posexplode(cut_sectors(F.col("content"), n, payload)).alias("seq", "data"))


def _blocks_sql(payload: int) -> str:
    return f"(SELECT doc_id, CAST(seq AS INTEGER) AS seq, substr(h, seq * {2 * payload} + 1, {2 * payload}) AS data FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(CAST(ceil(octet_length(encode(text)) / {payload}.0) AS BIGINT))) AS seq FROM documents))"


def _sectorize(payload: int) -> Query:
    def run(spark, sf_dir):
        return _blocks(table(spark, sf_dir, "documents"), payload).select("doc_id", "seq", F.octet_length("data").cast("bigint").alias("n_bytes"), F.md5(F.hex("data")).alias("payload_md5"))

    run.__name__ = f"sectorize_{payload}"
    return run


for _payload in (488, 512):
    query(f"SELECT doc_id, seq, length(data) // 2 AS n_bytes, md5(data) AS payload_md5 FROM {_blocks_sql(_payload)}")(_sectorize(_payload))

NEED_SQL = "SELECT *, CAST(ceil(size / 488.0) AS BIGINT) AS data_blocks, CAST(ceil(ceil(size / 488.0) / 72.0) AS BIGINT) AS header_blocks FROM (SELECT doc_id, lang, octet_length(encode(text)) AS size FROM documents)"


def _need(spark, sf_dir) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length(content()).cast("bigint").alias("size"))
    data = F.ceil(F.col("size") / 488)
    return sized.select("*", data.alias("data_blocks"), F.ceil(data / 72).alias("header_blocks"))


@query(f"SELECT doc_id, lang, size, data_blocks, header_blocks, data_blocks + header_blocks AS total_blocks, CAST(coalesce(sum(data_blocks + header_blocks) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM ({NEED_SQL})")
def block_need_and_offset(spark, sf_dir):
    need = _need(spark, sf_dir).withColumn("total_blocks", F.col("data_blocks") + F.col("header_blocks"))
    return running_sum(need, ["lang"], "doc_id", F.col("total_blocks"), "block_offset")


@query(f"""
    WITH need AS (SELECT doc_id, lang, data_blocks + header_blocks AS n, coalesce(sum(data_blocks + header_blocks) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_rank FROM ({NEED_SQL})),
    free AS (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS rank FROM (SELECT unnest(range(2, (SELECT CAST(max(first_rank + n) AS BIGINT) FROM need) * 7 // 6 + 16)) AS sector) WHERE sector % 7 <> 0)
    SELECT doc_id, lang, CAST(n AS BIGINT) AS blocks, min(sector) AS first_sector, max(sector) AS last_sector
    FROM need JOIN free ON rank >= first_rank AND rank < first_rank + n GROUP BY ALL""")
def first_fit_sectors(spark, sf_dir):
    """Each document takes the lowest free sectors of its volume, in doc_id order; every seventh sector is in use."""
    need = _need(spark, sf_dir).select("doc_id", "lang", (F.col("data_blocks") + F.col("header_blocks")).alias("blocks"))
    need = running_sum(need, ["lang"], "doc_id", F.col("blocks"), "first_rank").where("blocks > 0")
    most = need.agg(F.max(F.col("first_rank") + F.col("blocks"))).first()[0] or 0
    used = spark.range(2, most * 7 // 6 + 16).withColumnRenamed("id", "sector").withColumn("disk", F.lit(0)).where("sector % 7 <> 0")
    free = running_sum(used, ["disk"], "sector", F.lit(1), "rank").select("rank", "sector")
    # ranks follow sectors, so the first and last rank of a document say all
    ends = need.withColumn("last_rank", F.col("first_rank") + F.col("blocks") - 1)
    for end in ("first", "last"):
        ends = ends.join(free.select(F.col("rank").alias(f"{end}_rank"), F.col("sector").alias(f"{end}_sector")), f"{end}_rank")
    return ends.select("doc_id", "lang", "blocks", "first_sector", "last_sector")


@query("""
    SELECT page_id, CAST(sector AS INTEGER) AS sector, (4294967296 - CAST(list_sum(list_transform(range(128), lambda i: CASE WHEN i = 5 THEN 0 ELSE CAST('0x' || substr(d, i * 8 + 1, 8) AS BIGINT) END)) AS BIGINT) % 4294967296) % 4294967296 AS checksum
    FROM (SELECT page_id, sector, rpad(substr(h, sector * 1024 + 1, 1024), 1024, '0') AS d FROM (SELECT page_id, hex(encode(html)) AS h, unnest(range(CAST(ceil(octet_length(encode(html)) / 512.0) AS BIGINT))) AS sector FROM pages))""")
def sector_checksum(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("d")).where(F.octet_length("d") > 0)
    cut = raw.select("page_id", F.posexplode(cut_sectors(F.col("d"), F.ceil(F.octet_length("d") / 512).cast("int"))).alias("sector", "part"))
    return cut.select("page_id", "sector", b.checksum(F.rpad("part", 512, F.lit(b"\0"))).alias("checksum"))


_BYTES = "list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), i * 2 + 1, 2) AS BIGINT))"


@query(f"SELECT n_nationkey, n_name, list_reduce(list_prepend(CAST(0 AS BIGINT), {_BYTES.format('n_name')}), lambda c, v: list_reduce(list_prepend(xor(c, v), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 40961) ELSE x >> 1 END)) AS crc FROM nation")
def crc16_track(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", b.crc16(F.encode("n_name", "UTF-8")).alias("crc"))


@query(f"SELECT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS id, CAST(list_sum({_BYTES.format('n_name')}) AS BIGINT) % 65536 AS checksum FROM nation UNION ALL SELECT 'part', p_partkey, CAST(list_sum({_BYTES.format('p_name')}) AS BIGINT) % 65536 FROM part")
def additive_checksum16(spark, sf_dir):
    one = table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    two = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return one.unionByName(two).select("kind", "id", b.additive16(F.encode("name", "UTF-8")).alias("checksum"))


@query("SELECT page_id, md5(html) AS md5 FROM pages")
def image_md5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode("html", "UTF-8")).alias("md5"))


@query("""
    WITH known AS (SELECT md5(text) AS md5, min(doc_id) AS least FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT doc_id, md5(text) AS md5, CASE WHEN least IS NULL THEN 'Nope! This disk is not in the catalogue!' ELSE 'Yes: doc' || least END AS outcome FROM documents LEFT JOIN known ON md5(text) = known.md5""")
def catalogue_match(spark, sf_dir):
    """Documents are images; the catalogue holds those that have labels, and the first of equal ones names them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(content()).alias("md5"))
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("md5", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("doc_id").alias("position"))
    return catalogue.match(docs.withColumn("reject_reason", F.lit(None).cast("string")), known, position="position").select("doc_id", "md5", "outcome")


_MAGIC = ["464F524D00000010494C424D", "464F524D00000010414E494D", "464F524D0000000058585858", "416D426B", "416D53700003", "416D4963", "E310", "444D5321"]


@query("SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(("CASE WHEN n >= 24 THEN 'ILBM' END", "CASE WHEN n >= 24 THEN 'ANIM' END", "'IFF'", "'AMBK'", "'AMSP'", "'AMIC'", "'ICON'", "'DMS'"))) + " END AS file_type FROM (SELECT doc_id, octet_length(encode(text)) + CASE WHEN doc_id % 8 < 3 THEN 12 ELSE 0 END AS n FROM documents)")
def type_detect(spark, sf_dir):
    """Documents after a file type's first bytes, by doc_id."""
    magic = F.unhex(F.element_at(F.array(*map(F.lit, _MAGIC)), (F.col("doc_id") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", detect.detect(F.concat(magic, content())).alias("file_type"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 'BOOTBLOCK' WHEN c_custkey = 880 THEN 'ROOTBLOCK' WHEN s_suppkey IS NOT NULL THEN 'BITMAP BLOCK' WHEN c_nationkey = 2 THEN 'HEADER' WHEN c_nationkey = 8 THEN 'DATA BLOCK'
    WHEN c_nationkey = 16 THEN 'LIST' WHEN c_nationkey = 33 THEN 'DIRCACHE' ELSE 'EMPTY' END AS sector_type FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def sector_type(spark, sf_dir):
    """Customers are sectors, their nation the block's first long, and suppliers' keys the bitmap blocks."""
    from sectorlake.functions.blocks import sector_type as kind

    sectors = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("code"))
    marks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(True).alias("mark"))
    return sectors.join(marks, "c_custkey", "left").select("c_custkey", kind(F.col("c_custkey"), F.lit(880), F.col("code"), F.coalesce("mark", F.lit(False))).alias("sector_type"))


@query("""
    WITH e AS (SELECT lang, '' AS folder, 0 AS kind, source AS name FROM documents GROUP BY ALL UNION ALL SELECT lang, source, 1, 'doc' || doc_id FROM documents)
    SELECT lang, folder, kind, name, CAST(row_number() OVER (PARTITION BY lang, folder ORDER BY kind, name) AS INTEGER) AS position FROM e""")
def listing_sorted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folders = docs.select("lang", F.lit("").alias("folder"), F.lit(0).alias("kind"), F.col("source").alias("name")).distinct()
    files = docs.select("lang", F.col("source").alias("folder"), F.lit(1).alias("kind"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    run = F.concat(F.col("kind").cast("string"), F.substring("name", 1, 7))  # a folder may hold any number of files
    return ranked(folders.unionByName(files), ["lang", "folder"], run, ["kind", "name"], "position").withColumn("position", F.col("position").cast("int"))


@query("SELECT lang, source, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def folder_sizes(spark, sf_dir):
    """An extension: sizes of folders."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum(F.octet_length(content())).alias("bytes"))


@query("""
    WITH RECURSIVE node AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
    walk AS (SELECT id, name AS path, 0 AS depth FROM node WHERE parent IS NULL UNION ALL SELECT n.id, w.path || '/' || n.name, w.depth + 1 FROM walk w JOIN node n ON n.parent = w.id)
    SELECT id, path, depth FROM walk""")
def tree_paths(spark, sf_dir):
    from sectorlake.operators.volume import paths

    t = lambda name: table(spark, sf_dir, name)
    mark = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = t("region").select(mark("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(t("nation").select(mark("n", "n_nationkey").alias("id"), mark("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(t("customer").select(mark("c", "c_custkey").alias("id"), mark("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    return paths(nodes, levels=3)


_STAMP_SQL = "SELECT event_id, m // 86400000000 AS days, m % 86400000000 // 60000000 AS minutes, m % 60000000 // 20000 AS ticks FROM (SELECT event_id, epoch_us(ts) - 252460800000000 AS m FROM events)"


def _datestamps(spark, sf_dir) -> DataFrame:
    # a timestamp without zone counts as UTC whatever the session's zone
    micros = table(spark, sf_dir, "events").select("event_id", F.timestamp_diff("MICROSECOND", F.lit(f.EPOCH).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("m"))
    return micros.select("event_id", F.expr("m DIV 86400000000").alias("days"), F.expr("(m % 86400000000) DIV 60000000").alias("minutes"), F.expr("(m % 60000000) DIV 20000").alias("ticks"))


@query(_STAMP_SQL)
def datestamp_encode(spark, sf_dir):
    return _datestamps(spark, sf_dir)


@query(f"SELECT event_id, TIMESTAMP '1978-01-01' + to_days(CAST(days AS INTEGER)) + to_minutes(minutes) + to_microseconds(ticks * 20000) AS changed_at FROM ({_STAMP_SQL})")
def datestamp_decode(spark, sf_dir):
    return _datestamps(spark, sf_dir).select("event_id", f.timestamp(F.col("days"), F.col("minutes"), F.col("ticks")).alias("changed_at"))


@query("""
    WITH s AS (SELECT doc_id, octet_length(encode(text)) * 1000 AS n FROM documents), k AS (SELECT *, floor(n / 1024.0 + 0.5) AS kb FROM s), m AS (SELECT *, floor(kb / 1024.0 + 0.5) AS mb FROM k), g AS (SELECT *, floor(mb / 1024.0 + 0.5) AS gb FROM m)
    SELECT doc_id, CASE WHEN n < 1024 THEN CASE WHEN n = 0 THEN 1 ELSE n END || ' bytes' WHEN kb < 1024 THEN CAST(kb AS BIGINT) || ' kb' WHEN mb < 1024 THEN CAST(mb AS BIGINT) || ' mb' ELSE CAST(gb AS BIGINT) || ' gb' END AS shown FROM g""")
def format_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", f.size_text(F.octet_length(content()).cast("bigint") * 1000).alias("shown"))


@query("SELECT doc_id, greatest(1, CAST(floor(octet_length(encode(text)) / 1024.0 + 0.5) AS BIGINT)) || ' kb' AS shown FROM documents")
def format_size_kb(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", f.size_kb(F.octet_length(content())).alias("shown"))


@query("SELECT page_id, array_to_string(list_transform(range(CAST(ceil(length(h) / 32.0) AS BIGINT)), lambda i: trim(regexp_replace(substr(h, i * 32 + 1, 32), '(..)', '\\1 ', 'g'))), chr(10)) AS dump FROM (SELECT page_id, hex(encode(html)) AS h FROM pages)")
def hex_dump(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", f.hex_dump(F.encode("html", "UTF-8")).alias("dump"))


@query("""
    WITH t AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM t)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS length FROM r GROUP BY ALL""")
def rle_runs(spark, sf_dir):
    """Runs of equal symbols, per user.  A user's events are looked at in spans of event_id; each span knows the symbol before it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.col("event_id") / SPAN).alias("span"))
    spans = events.groupBy("user_id", "span").agg(F.max_by(F.struct("event_type"), "event_id").alias("last"))
    spans = spans.select("user_id", "span", F.lag("last").over(Window.partitionBy("user_id").orderBy("span")).alias("ahead"))
    inside = F.lag(F.struct("event_type")).over(Window.partitionBy("user_id", "span").orderBy("event_id"))
    marked = events.join(spans, ["user_id", "span"]).withColumn("before", F.coalesce(inside, "ahead"))
    start = F.when(F.col("event_type") == F.col("before.event_type"), 0).otherwise(1)
    numbered = running_sum(marked.select("user_id", "event_id", "event_type", start.alias("start")), ["user_id"], "event_id", F.col("start"), "sum")
    return numbered.groupBy("user_id", (F.col("sum") + F.col("start")).alias("run"), "event_type").agg(F.count("*").alias("length"))


@query(f"SELECT doc_id, seq // 11 AS track, seq // 22 AS cylinder, count(*) AS sectors, CAST(sum(length(data) // 2) AS BIGINT) AS bytes FROM {_blocks_sql(512)} GROUP BY ALL")
def track_layout(spark, sf_dir):
    cut = _blocks(table(spark, sf_dir, "documents"), 512).select("doc_id", F.expr(f"CAST(seq DIV {TRACK} AS INT)").alias("track"), F.expr(f"CAST(seq DIV {CYLINDER} AS INT)").alias("cylinder"), F.octet_length("data").alias("n"))
    return cut.groupBy("doc_id", "track", "cylinder").agg(F.count("*").alias("sectors"), F.sum("n").alias("bytes"))


@query("SELECT (c_custkey - 1) // 32 AS word, CAST(sum(CASE WHEN c_custkey % 7 <> 0 THEN CAST(1 AS BIGINT) << CAST((c_custkey - 1) % 32 AS INTEGER) ELSE 0 END) AS BIGINT) AS packed FROM customer GROUP BY ALL")
def bitmap_pack(spark, sf_dir):
    """Customers are sectors; every seventh is in use."""
    flags = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("bit_idx"), F.when(F.col("c_custkey") % 7 != 0, 1).otherwise(0).alias("free"))
    return encode.packed_longs(flags, []).select(F.col("word").cast("bigint").alias("word"), F.col("value").alias("packed"))


def _free(strict: bool) -> Query:
    def run(spark, sf_dir):
        flags = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 7 != 0, 1).otherwise(0).alias("free"))
        bits = running_sum(flags, ["c_nationkey"], "c_custkey", F.lit(1), "bit")
        sized = bits.join(flags.groupBy("c_nationkey").agg(F.count("*").alias("sectors")), "c_nationkey")
        counted = sized.where(F.col("bit") < F.col("sectors") - (2 if strict else 0))
        return counted.groupBy("c_nationkey").agg((F.sum("free") * 512).alias("free_bytes"), F.max(F.col("sectors") * 512).alias("total_bytes"))

    run.__name__ = "free_size_strict" if strict else "free_size"
    return run


for _strict in (False, True):
    query(f"""
        WITH t AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS bit, CASE WHEN c_custkey % 7 <> 0 THEN 1 ELSE 0 END AS free, count(*) OVER (PARTITION BY c_nationkey) AS sectors FROM customer)
        SELECT c_nationkey, CAST(sum(free) * 512 AS BIGINT) AS free_bytes, max(sectors * 512) AS total_bytes FROM t WHERE bit <= sectors - {2 * _strict} GROUP BY 1""")(_free(_strict))


@query("SELECT doc_id, md5(text) AS data FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) UNION ALL SELECT doc_id, 'patch' || coalesce(quality, -1) FROM labels")
def overlay_write(spark, sf_dir):
    """Documents are sectors; those with a label are overwritten."""
    from sectorlake.operators.overlay import overlay

    base = table(spark, sf_dir, "documents").select("doc_id", F.md5(content()).alias("data"))
    patch = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("patch"), F.coalesce("quality", F.lit(-1)).cast("string")).alias("data"))
    return overlay(base, patch, ["doc_id"])


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990)")
def empty_folder(spark, sf_dir):
    children = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(children, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


# Images made of the documents: every 64 doc_ids of a language are an image, with a folder for each source.
_IMAGE_SQL = "SELECT doc_id, lang || '-' || doc_id // 64 AS disk_id, source, doc_id // 64 % 2 = 1 AS ffs, octet_length(encode(text)) AS size, text FROM documents"
_NEED = "CAST(ceil(size / CASE WHEN ffs THEN 512.0 ELSE 488.0 END) AS BIGINT)"


def _image_files(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    group = F.expr("doc_id DIV 64")
    return docs.select("doc_id", F.concat_ws("-", "lang", group.cast("string")).alias("disk_id"), "source", (group % 2 == 1).alias("ffs"), content().alias("content"))


def _written_images(spark, sf_dir) -> DataFrame:
    from sectorlake.operators import write
    from sectorlake.sources.images import described

    held = _image_files(spark, sf_dir)
    need = write.block_need(F.octet_length("content"), F.col("ffs"))["total"]
    size = F.sum(need) + F.countDistinct("source")
    spec = held.groupBy("disk_id", "ffs").agg((size + F.floor(size / 2000) * 2 + 16).alias("n"))
    spec = spec.select("disk_id", (F.col("n") + F.col("n") % 2).cast("int").alias("sectors"), F.col("disk_id").alias("label"), "ffs")
    folders = held.select("disk_id", F.lit(0).cast("bigint").alias("seq"), F.lit("mkdir").alias("op"), F.lit("").alias("path"), F.col("source").alias("name"), F.lit(None).cast("binary").alias("content")).distinct()
    files = held.select("disk_id", (F.col("doc_id") + 1).alias("seq"), F.lit("write").alias("op"), F.col("source").alias("path"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "content")
    return described(write.create(spec, folders.unionByName(files)).select("disk_id", "content"))


@query(f"SELECT disk_id, source || '/doc' || doc_id AS path, size, md5(text) AS md5 FROM ({_IMAGE_SQL})")
def image_files(spark, sf_dir):
    """Documents written to images as files, and read back."""
    from sectorlake.operators import volume

    return volume.files(_written_images(spark, sf_dir)).select("disk_id", "path", "size", F.md5("content").alias("md5"))


@query(f"""
    WITH need AS (SELECT disk_id, source, {_NEED} AS data FROM ({_IMAGE_SQL})),
    used AS (SELECT disk_id, CAST(sum(data + greatest(1, CAST(ceil(data / 72.0) AS BIGINT))) + count(DISTINCT source) AS BIGINT) AS blocks FROM need GROUP BY 1),
    made AS (SELECT disk_id, blocks, (blocks + blocks // 2000 * 2 + 16 + 1) // 2 * 2 AS sectors FROM used)
    SELECT disk_id, sectors * 512 AS total_size, sectors - 2 - 1 - CAST(ceil((sectors - 2) / 4064.0) AS BIGINT) - blocks AS free_blocks FROM made""")
def image_space(spark, sf_dir):
    """The space left on these images."""
    from sectorlake.operators import volume

    return volume.free_size(_written_images(spark, sf_dir), strict=True).select("disk_id", "total_size", "free_blocks")


@query(f"SELECT disk_id, source AS folder, 'doc' || doc_id AS name, {HASH_SQL.replace('p_name', '(chr(100) || chr(111) || chr(99) || doc_id)')} AS bucket FROM ({_IMAGE_SQL})")
def image_listing(spark, sf_dir):
    """The entries of these images' folders with the slots they hang on."""
    from sectorlake.operators import volume

    entries = volume.dir_entries(_written_images(spark, sf_dir))
    return entries.where("type_string = 'FILE'").select("disk_id", F.col("dir_name").alias("folder"), "name", F.col("bucket").cast("bigint").alias("bucket"))
