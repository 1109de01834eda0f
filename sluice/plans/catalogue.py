"""The queries over the driver's tables and the SQL that must give the same rows.

A query renders columns of a table as text or as records, reads them back through a plan, and returns what it finds; its
SQL computes the same from the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.constraints import Constraints, checked
from sluice.functions.doors import DMY, MDY, YMD, COMPACT_DATE, DateOptions, door
from sluice.functions.numbers import ALL, EUROZONE, INDIAN, NumFormat
from sluice.operators.suggest import suggest
from sluice.plans.columns import Column
from sluice.plans.dialect import Dialect
from sluice.sources.delimited import Delimited
from sluice.plans.sample_packages import ods_bytes, xlsx_bytes
from sluice.sources.workbook import Workbook, cell, typed_door
from sluice.types import Door
from sluice.working import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Records of a rendered source.
SOURCE_ROWS = 5000


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(rows: DataFrame, order: SparkColumn, line: SparkColumn, head: str = "", end: str = "\n") -> DataFrame:
    """Sources of up to SOURCE_ROWS lines each, in order of an integer key; every one has the head."""
    parts = rows.select(F.floor(order / SOURCE_ROWS).alias("_part"), order.alias("_key"), line.alias("_text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_key", "_text"))), lambda x: x["_text"]), end)
    return parts.groupBy("_part").agg(F.concat(F.lit(head), body, F.lit(end)).cast("binary").alias("_bytes")).select(F.format_string("part-%08d", "_part").alias("_source"), "_bytes")


def quoted(c: SparkColumn) -> SparkColumn:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _key() -> SparkColumn:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


@query("""SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DECIMAL(38,2)::VARCHAR AS price, count(*) AS n, count(*) FILTER (WHERE l_orderkey % 7 = 0) AS bad_quantities,
max(CAST(l_shipdate AS DATE)) AS last_ship FROM lineitem GROUP BY l_returnflag""")
def lineitem_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text and back: integers, decimals, reals, dates and text, with a fault in every seventh order."""
    rows = table(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_orderkey") % 7 == 0, "many").otherwise(F.col("l_quantity").cast("int").cast("string"))
    line = F.concat_ws(",", F.col("l_orderkey").cast("string"), quantity, F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_shipdate").cast("date").cast("string"), quoted(F.col("l_returnflag")))
    plan = [Column("id", Door.I64), Column("quantity", Door.I32), Column("price", Door.DECIMAL, decimal=(18, 2)), Column("ship", Door.DATE), Column("flag", Door.TEXT)]
    typed = Delimited(rendered(rows, _key(), line, "id,quantity,price,ship,flag\n")).bind(plan).read()
    values = typed.frame.select(F.col("flag.value").alias("l_returnflag"), F.col("price.value").alias("price"), F.col("quantity.reason").alias("q"), F.col("ship.value").alias("ship"))
    return values.groupBy("l_returnflag").agg(F.sum("price").cast("decimal(38,2)").cast("string").alias("price"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("q").isNotNull()).alias("bad_quantities"), F.max("ship").alias("last_ship"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_round_trip(spark, sf_dir)


_WORDS = ["true", "FALSE", "Yes", "no", "Y", "n", "on", "OFF", " in ", "out", "2", ""]


@query("""SELECT value, reason, count(*) AS n FROM (SELECT CASE (l_orderkey + l_linenumber) % 12 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN true WHEN 7 THEN false WHEN 8 THEN true WHEN 9 THEN false END AS value,
CASE (l_orderkey + l_linenumber) % 12 WHEN 10 THEN 'malformed' WHEN 11 THEN 'empty' END AS reason FROM lineitem) GROUP BY ALL""")
def door_bool_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _WORDS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 12).cast("int"))
    cells = table(spark, sf_dir, "lineitem").select(door(Door.BOOL, text).alias("c"))
    return cells.groupBy(F.col("c.value").alias("value"), F.col("c.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, (o_orderkey * 37)::BIGINT AS value, CAST(NULL AS VARCHAR) AS reason FROM orders")
def door_i64_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_number(F.col("o_orderkey") * 37, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", door(Door.I64, text).alias("c")).select("o_orderkey", F.col("c.value").alias("value"), F.col("c.reason").alias("reason"))


@query("""SELECT o_orderkey, n AS indian, CASE WHEN n < 100000 THEN n END AS western, CASE WHEN n >= 100000 THEN 'groupSize' END AS western_detail FROM (SELECT o_orderkey, (o_orderkey * 1237 % 90000000 + 1000)::BIGINT AS n FROM orders)""")
def door_i64_indian(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * 1237 % 90000000 + 1000).cast("string")
    head = F.expr("substring(n, 1, length(n) - 3)")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))
    grouped = F.concat(F.reverse(F.regexp_replace(F.reverse(head), r"(\d\d)(?=\d)", "$1,")), F.lit(","), F.expr("right(n, 3)"))
    cells = rows.select("o_orderkey", door(Door.I64, grouped, form=NumFormat(flags=ALL | INDIAN)).alias("i"), door(Door.I64, grouped).alias("w"))
    return cells.select("o_orderkey", F.col("i.value").alias("indian"), F.col("w.value").alias("western"), F.col("w.detail").alias("western_detail"))


@query("""SELECT p_partkey, CASE WHEN v BETWEEN 0 AND 255 THEN v END::SMALLINT AS value, CASE WHEN v BETWEEN 0 AND 255 THEN NULL ELSE 'out_of_range' END AS reason,
CASE WHEN v < 0 THEN 'negativeNotAllowed' WHEN v > 255 THEN 'tooLarge' END AS detail FROM (SELECT p_partkey, p_partkey % 400 - 20 AS v FROM part)""")
def door_u8_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select("p_partkey", door(Door.U8, (F.col("p_partkey") % 400 - 20).cast("string")).alias("c"))
    return cells.select("p_partkey", F.col("c.value").alias("value"), F.col("c.reason").alias("reason"), F.col("c.detail").alias("detail"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS comma, CASE WHEN l_extendedprice < 1000 THEN NULL ELSE 'malformed' END AS point_reason FROM lineitem")
def door_f64_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notation with a decimal comma, read under itself and under the one with a point."""
    text = F.translate(F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), ".,", ",.")
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), door(Door.F64, text, form=EUROZONE).alias("c"), door(Door.F64, text).alias("p"))
    return cells.select("l_orderkey", "l_linenumber", F.col("c.value").alias("comma"), F.when(F.col("x") >= 1000, F.col("p.reason")).alias("point_reason"))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2))::DOUBLE AS value, CAST(NULL AS VARCHAR) AS reason, CASE WHEN true THEN 'malformed' END AS plain_reason FROM customer")
def door_decimal_currency_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.concat(F.lit("$"), F.format_number(F.abs(F.col("c_acctbal").cast("decimal(18,2)")), 2))
    text = F.when(F.col("c_acctbal").cast("decimal(18,2)") < 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(money)
    cells = table(spark, sf_dir, "customer").select("c_custkey", door(Door.DECIMAL, text, form=NumFormat(currency="$"), precision=18, scale=2).alias("c"), door(Door.DECIMAL, text).alias("p"))
    return cells.select("c_custkey", F.col("c.value").cast("double").alias("value"), F.col("c.reason").alias("reason"), F.col("p.reason").alias("plain_reason"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ymd, CAST(o_orderdate AS DATE) AS mdy, CAST(o_orderdate AS DATE) AS dmy, CAST(o_orderdate AS DATE) AS compact,
CASE WHEN day(o_orderdate) > 12 THEN 'out_of_range' END AS swapped FROM orders""")
def door_date_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    shown = {k: F.date_format(d, p) for k, p in (("ymd", "yyyy/M/d"), ("mdy", "M/d/yyyy"), ("dmy", "dd.MM.yyyy"), ("compact", "yyyyMMdd"))}
    cells = table(spark, sf_dir, "orders").select("o_orderkey", *(door(Door.DATE_ORDERED, shown[o], order=o).alias(o) for o in (YMD, MDY, DMY)), door(Door.DATE, shown["compact"], options=DateOptions((COMPACT_DATE,))).alias("compact"), door(Door.DATE_ORDERED, shown["dmy"], order=MDY).alias("swapped"))
    return cells.select("o_orderkey", *(F.col(f"{k}.value").alias(k) for k in shown), F.col("swapped.reason").alias("swapped"))


@query("SELECT event_id, epoch_us(ts)::BIGINT AS utc_us, (epoch_us(ts) - 3600000000)::BIGINT AS east_us, 'componentMissing' AS bare FROM events")
def door_timestamp_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    cells = table(spark, sf_dir, "events").select("event_id", *(door(Door.TIMESTAMP, F.concat(shown, F.lit(z))).alias(k) for k, z in (("utc", "Z"), ("east", "+01:00"), ("bare", ""))))
    return cells.select("event_id", F.unix_micros("utc.value").alias("utc_us"), F.unix_micros("east.value").alias("east_us"), F.col("bare.detail").alias("bare"))


@query("SELECT event_id, (epoch_us(ts) // 1000000 * 1000000)::BIGINT AS s, (epoch_us(ts) // 1000 * 1000)::BIGINT AS ms, epoch_us(ts)::BIGINT AS us, epoch_us(ts)::BIGINT AS ns FROM events")
def door_unix_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    shown = {"s": F.floor(us / 1_000_000), "ms": F.floor(us / 1000), "us": us, "ns": F.concat(us.cast("string"), F.lit("321"))}
    cells = table(spark, sf_dir, "events").select("event_id", *(door(Door.UNIX, t.cast("string"), precision=p).alias(p) for p, t in shown.items()))
    return cells.select("event_id", *(F.unix_micros(f"{p}.value").alias(p) for p in shown))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 1462 AS day_1904, (o_orderkey % 4) * 21600 AS second,
CASE o_orderkey % 3 WHEN 0 THEN 'out_of_range' WHEN 1 THEN 'malformed' ELSE 'out_of_range' END AS odd FROM orders""")
def door_excel_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    quarter = F.get(F.array(*map(F.lit, ("", ".25", ".5", ".75"))), (F.col("o_orderkey") % 4).cast("int"))
    odd = F.get(F.array(*map(F.lit, ("60", "-1", "2958466"))), (F.col("o_orderkey") % 3).cast("int"))
    text = F.concat(days.cast("string"), quarter)
    cells = table(spark, sf_dir, "orders").select("o_orderkey", door(Door.EXCEL_SERIAL, text).alias("c"), door(Door.EXCEL_SERIAL, text, epoch=1904).alias("e"), door(Door.EXCEL_SERIAL, odd).alias("o"))
    at = F.col("c.value")
    return cells.select("o_orderkey", at.cast("date").alias("day"), F.col("e.value").cast("date").alias("day_1904"), F.pmod(F.unix_seconds(at), F.lit(86400)).alias("second"), F.col("o.reason").alias("odd"))


@query("""SELECT event_id, (n % 86400 * 1000000000 + 500000000)::BIGINT AS time_ns, CASE WHEN n % 2 = 0 THEN n ELSE -n END::BIGINT * 1000000000 AS duration_ns, 'unknownUnit' AS calendar, 'timeFieldOutOfRange' AS late FROM (SELECT event_id, event_id * 97 % 500000 AS n FROM events)""")
def door_time_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") * 97 % 500000
    part = lambda x, p: F.format_string(p, x.cast("int"))
    day = n % 86400
    clock = F.concat(part(F.floor(day / 3600), "%02d:"), part(F.floor(day / 60) % 60, "%02d:"), part(day % 60, "%02d.5"))
    span = F.concat(F.when(n % 2 == 0, "").otherwise("-"), part(F.floor(n / 86400), "P%dDT"), part(F.floor(n / 3600) % 24, "%dH"), part(F.floor(n / 60) % 60, "%dM"), part(n % 60, "%dS"))
    cells = table(spark, sf_dir, "events").select("event_id", door(Door.TIME, clock).alias("t"), door(Door.DURATION, span).alias("d"), door(Door.DURATION, F.lit("P1Y2M")).alias("c"), door(Door.TIME, F.lit("24:00:00")).alias("l"))
    return cells.select("event_id", F.col("t.value").alias("time_ns"), F.col("d.value").alias("duration_ns"), F.col("c.detail").alias("calendar"), F.col("l.detail").alias("late"))


@query("""SELECT c_custkey, regexp_replace(md5(c_custkey::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS bare, regexp_replace(md5(c_custkey::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS dashed, 'wrongLength' AS short FROM customer""")
def door_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    dashed = F.upper(F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    cells = table(spark, sf_dir, "customer").select("c_custkey", door(Door.UUID, h).alias("b"), door(Door.UUID, dashed).alias("d"), door(Door.UUID, F.substring(h, 1, 30)).alias("s"))
    return cells.select("c_custkey", F.col("b.value").alias("bare"), F.col("d.value").alias("dashed"), F.col("s.detail").alias("short"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars, md5(text) AS same, 'invalidUtf8' AS broken, strlen(text)::BIGINT AS broken_at FROM documents")
def door_text_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are, an empty one too, and with a byte behind that isn't UTF-8; where there is no text that byte stands alone."""
    raw = F.col("text").cast("binary")
    broken = F.concat(F.coalesce(raw, F.lit(b"")), F.lit(b"\xff"))
    cells = table(spark, sf_dir, "documents").select("doc_id", raw.isNotNull().alias("there"), door(Door.TEXT, raw).alias("c"), door(Door.TEXT, broken).alias("b"))
    v = F.when(F.col("c.reason") == "empty", "").otherwise(F.col("c.value"))
    return cells.select("doc_id", F.octet_length(v).cast("bigint").alias("bytes"), F.char_length(v).cast("bigint").alias("chars"), F.md5(v.cast("binary")).alias("same"), F.col("b.detail").alias("broken"), F.when(F.col("there"), F.col("b.offset")).cast("bigint").alias("broken_at"))


@query("""SELECT coalesce(i.reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN trim(t) = '' THEN 'empty' WHEN NOT regexp_full_match(t, '[0-9]+') THEN 'malformed' WHEN TRY_CAST(t AS TINYINT) IS NULL THEN 'out_of_range' END AS reason
FROM (SELECT CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN event_type ELSE regexp_extract(props, '[0-9]+') END AS t FROM events)) i GROUP BY ALL""")
def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, F.col("event_type")).otherwise(F.regexp_extract("props", "[0-9]+", 0))
    cells = table(spark, sf_dir, "events").select(door(Door.I8, text)["reason"].alias("r"))
    return cells.groupBy(F.coalesce("r", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS inherited, CASE WHEN c_custkey % 4 = 0 THEN 'token' WHEN c_custkey % 4 = 1 THEN 'padded' ELSE 'cell' END AS origin,
CASE WHEN c_custkey % 4 = 0 THEN 'NA' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_nationkey::VARCHAR END AS opted_out FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer)""")
def tokens_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token of the dialect, a column that opts out of it, and cells that short rows lack."""
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(",NA"))).when(k % 4 == 1, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(","), F.col("c_nationkey").cast("string")))
    d = Dialect(short_rows="pad", tokens=("NA",))
    plan = [Column("id", Door.I64), Column("n", Door.TEXT), Column("n", Door.TEXT, "m", tokens=())]
    t = Delimited(rendered(table(spark, sf_dir, "customer"), k, line, "id,n\n"), d).bind(plan).read().frame
    return t.select(F.col("id.value").alias("c_custkey"), F.col("n.value").alias("inherited"), F.col("n.origin").alias("origin"), F.col("m.value").alias("opted_out"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 1 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 7 = 1 THEN 1 WHEN event_id % 7 = 2 THEN 3 ELSE 2 END AS width, event_id % 7 = 2 AS reported FROM events""")
def rows_pad_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    line = F.concat(k.cast("string"), F.when(k % 7 == 1, "").when(k % 7 == 2, F.concat(F.lit(","), F.col("event_type"), F.lit(",more"))).otherwise(F.concat(F.lit(","), F.col("event_type"))))
    d = Dialect(short_rows="pad", long_rows="report")
    typed = Delimited(rendered(table(spark, sf_dir, "events"), k, line, "id,kind\n"), d).bind([Column("id", Door.I64), Column("kind", Door.TEXT)]).read()
    long = typed.problems().where("reason = 'long_row'").select("_source", "_record", F.lit(True).alias("r"))
    rows = typed.frame.join(long, ["_source", "_record"], "left")
    return rows.select(F.col("id.value").alias("event_id"), F.col("kind.value").alias("kind"), F.col("_width").alias("width"), F.coalesce("r", F.lit(False)).alias("reported"))


@query("""SELECT key, plan_column, reason, detail FROM (
SELECT p_partkey AS key, 0 AS plan_column, 'malformed' AS reason, 'unexpectedCharacter' AS detail FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 1, 'out_of_range', 'tooLarge' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 2, 'out_of_range', 'nonexistentDate' FROM part WHERE p_partkey % 4 = 0)""")
def problems_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat_ws(",", k.cast("string"), F.when(k % 3 == 0, "12x").otherwise("12"), F.when(k % 5 == 0, "300").otherwise("30"), F.when(k % 4 == 0, "2023-02-29").otherwise("2024-02-29"))
    plan = [Column("a", Door.I32), Column("b", Door.U8), Column("d", Door.DATE), Column("id", Door.I64)]
    typed = Delimited(rendered(table(spark, sf_dir, "part"), k, line, "id,a,b,d\n")).bind(plan).read()
    ids = typed.frame.select("_source", "_record", F.col("id.value").alias("key"))
    return typed.problems().join(ids, ["_source", "_record"]).select("key", "plan_column", "reason", "detail")


@query("""SELECT doc_id, CASE WHEN text <> '' THEN md5(text) END AS same, CASE WHEN text <> '' THEN strlen(text) END::BIGINT AS bytes, CASE WHEN coalesce(text, '') = '' THEN 'empty' END AS reason FROM documents""")
def frame_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their line ends and quotes as quoted cells, and back; null and empty ones are empty cells."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    typed = Delimited(rendered(rows, F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit(","), quoted(F.col("text"))), "id,text\n", "\r\n")).bind([Column("id", Door.I64), Column("text", Door.TEXT)]).read()
    v = F.col("text.value")
    return typed.frame.select(F.col("id.value").alias("doc_id"), F.md5(v.cast("binary")).alias("same"), F.octet_length(v).cast("bigint").alias("bytes"), F.col("text.reason").alias("reason"))


@query("SELECT s_suppkey, s_name FROM supplier")
def frame_skip_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title with a stray quote, a discarded record, a header, and a blank line after each record."""
    k = F.col("s_suppkey")
    sources = rendered(table(spark, sf_dir, "supplier"), k, F.concat(k.cast("string"), F.lit("\t"), F.col("s_name"), F.lit("\n")), 'a "title\nnot,this\nid\tname\n')
    typed = Delimited(sources, Dialect(separator="\t", skip=1, header_row=1)).bind([Column("id", Door.I64), Column("name", Door.TEXT)]).read()
    return typed.values().select(F.col("id").alias("s_suppkey"), F.col("name").alias("s_name"))


@query("""SELECT part, count(*) FILTER (WHERE k % 5000 < 4000) AS intact, CASE WHEN max(k % 5000) >= 4000 THEN 'column_count' END AS kind FROM (SELECT o_orderkey AS k, o_orderkey // 5000 AS part FROM orders) GROUP BY part HAVING max(k % 5000) >= 4000""")
def frame_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source breaks at its first key past 4000: the rows ahead are there, none after."""
    k = F.col("o_orderkey")
    line = F.concat(k.cast("string"), F.when(k % SOURCE_ROWS >= 4000, "").otherwise(","))
    reader = Delimited(rendered(table(spark, sf_dir, "orders"), k, line, "id,x\n")).bind([Column("id", Door.I64)])
    intact = reader.read().frame.groupBy("_source").agg(F.count(F.lit(1)).alias("intact"))
    out = reader.failures().join(intact, "_source", "left")
    return out.select(F.substring_index("_source", "-", -1).cast("bigint").alias("part"), F.coalesce("intact", F.lit(0)).cast("bigint").alias("intact"), "kind")


@query("""SELECT doc_id, CASE WHEN text <> '' THEN md5(regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g')) END AS latin, CASE WHEN text <> '' THEN md5(text) END AS wide FROM documents""")
def frame_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in Latin-1 (what it lacks as question marks) and in UTF-16."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for name, encoding, charset in (("latin", "latin-1", "ISO-8859-1"), ("wide", "utf-16le", "UTF-16LE")):
        text = F.regexp_replace("text", r"[^\x00-\xFF]", "?") if name == "latin" else F.col("text")
        line = F.concat(F.col("doc_id").cast("string"), F.lit(","), quoted(text))
        sources = rendered(rows, F.col("doc_id"), line).select("_source", F.encode(F.col("_bytes").cast("string"), charset).alias("_bytes"))
        typed = Delimited(sources, Dialect(has_header=False, encoding=encoding)).bind([Column(0, Door.I64, "doc_id"), Column(1, Door.TEXT, "text")]).read()
        mine = typed.values().select("doc_id", F.md5(F.col("text").cast("binary")).alias(name))
        out = mine if out is None else out.join(mine, "doc_id")
    return out


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'minimum' WHEN p_size >= 45 THEN 'exclusiveMaximum' WHEN p_size % 5 <> 0 THEN 'multipleOf' END AS strict, ((p_size + 4) // 5 * 5)::INTEGER AS up, p_size % 5 <> 0 AS adjusted, CASE WHEN p_size NOT IN (1, 7, 30) THEN 'enum' END AS listed FROM part""")
def constraints_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("p_size").cast("string")
    c = lambda rules: checked(door(Door.I32, text), text.cast("binary"), Door.I32, rules)
    cells = table(spark, sf_dir, "part").select("p_partkey", c(Constraints(minimum="10", exclusive_maximum="45", multiple_of="5")).alias("s"), c(Constraints(multiple_of="5", rounding="ceiling")).alias("u"), c(Constraints(enum=("1", "7.0", "30"))).alias("e"))
    return cells.select("p_partkey", F.col("s.keyword").alias("strict"), F.col("u.value").alias("up"), F.col("u.adjusted").alias("adjusted"), F.col("e.keyword").alias("listed"))


@query("""SELECT o_orderkey, CASE upper(o_orderstatus) WHEN 'F' THEN 'f' WHEN 'O' THEN 'o' END AS value, CASE WHEN upper(o_orderstatus) NOT IN ('F', 'O') THEN 'enum' END AS keyword, CASE upper(o_orderstatus) WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS enum_index,
CASE WHEN length(o_orderpriority) < 6 THEN 'minLength' WHEN length(o_orderpriority) > 8 THEN 'maxLength' END AS lengths FROM orders""")
def constraints_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")).cast("binary")
    long = F.col("o_orderpriority").cast("binary")
    cells = table(spark, sf_dir, "orders").select("o_orderkey", checked(door(Door.TEXT, raw), raw, Door.TEXT, Constraints(trim=True, enum=("f", "o", "F"))).alias("c"), checked(door(Door.TEXT, long), long, Door.TEXT, Constraints(min_length=6, max_length=8)).alias("l"))
    return cells.select("o_orderkey", F.when(F.col("c.reason").isNull(), F.col("c.value")).alias("value"), F.col("c.keyword").alias("keyword"), F.col("c.enum_index").alias("enum_index"), F.col("l.keyword").alias("lengths"))


@query("""SELECT * FROM (VALUES ('c_acctbal', 'f64', 'resolved'), ('c_custkey', 'i32', 'resolved'), ('c_name', 'text', 'resolved'), ('code', 'text', 'resolved'), ('dmy', 'date_ordered', 'resolved'), ('flag', 'bool', 'resolved'), ('iso', 'date', 'resolved'), ('uuid', 'uuid', 'resolved')) AS t(name, door, status)""")
def suggest_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey").select(
        k.cast("string").alias("c_custkey"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("c_acctbal"), "c_name",
        F.when(k % 2 == 0, "yes").otherwise("no").alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 360).cast("int")).cast("string").alias("iso"),
        F.concat((k % 28 + 1).cast("string"), F.lit("/"), (k % 12 + 1).cast("string"), F.lit("/2024")).alias("dmy"),
        F.concat(F.lit("0"), k.cast("string")).alias("code"), F.md5(k.cast("string").cast("binary")).alias("uuid"),
    )
    found, _ = suggest(rows)
    return spark.createDataFrame([(n, s.door.value, s.status) for n, s in sorted(found.items())], "name string, door string, status string")


_SHEET = "SELECT c_custkey AS id, c_name AS name, CAST(c_acctbal AS DECIMAL(12,2))::DOUBLE AS balance, (DATE '2024-01-01' + (c_custkey % 300)::INTEGER) AS day, c_custkey % 2 = 0 AS even FROM customer"


def _sheet(spark: SparkSession, sf_dir: str, make: Callable[[list], bytes]) -> DataFrame:
    """All customers as workbooks of up to SOURCE_ROWS rows, each made in a task, and back."""
    from datetime import date, timedelta

    def packages(batches):
        import pyarrow as pa

        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = [["id", "name", "balance", "day", "even"]] + [[float(r["k"]), r["n"], r["b"], date(2024, 1, 1) + timedelta(days=r["k"] % 300), r["k"] % 2 == 0] for r in rows]
                yield pa.RecordBatch.from_pydict({"_source": [f"part-{part:08d}"], "_bytes": [make(cells)]})

    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / SOURCE_ROWS).alias("part"), F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_acctbal").cast("decimal(12,2)").cast("double").alias("b")).alias("r"))
    sources = rows.groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rows")).mapInArrow(packages, "_source string, _bytes binary")
    plan = [Column(0, Door.I64, "id"), Column(1, Door.TEXT, "name"), Column(2, Door.F64, "balance"), Column(3, Door.DATE, "day"), Column(4, Door.BOOL, "even")]
    return Workbook(sources).read("Data", plan, epoch=1900).values()


@query(_SHEET)
def sheet_xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, xlsx_bytes)


@query(_SHEET)
def sheet_ods_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, ods_bytes)


_MATRIX = {
    "number": (cell("number", "7", 7.0), {"bool": "malformed", "text": "ok", "i32": "ok", "f64": "ok", "time": "ok", "duration": "ok", "date": "ok"}),
    "fraction": (cell("number", "0.5", 0.5), {"bool": "malformed", "text": "ok", "i32": "malformed", "f64": "ok", "time": "ok", "duration": "ok", "date": "out_of_range"}),
    "bool": (cell("bool", "true", 1.0), {"bool": "ok", "text": "ok", "i32": "malformed", "f64": "malformed", "time": "malformed", "duration": "malformed", "date": "malformed"}),
    "clock": (cell("clock", "01:00:00", 0.04, None, 3_600_000_000_000), {"bool": "malformed", "text": "ok", "i32": "malformed", "f64": "malformed", "time": "ok", "duration": "ok", "date": "malformed"}),
    "long_span": (cell("span", "P2D", 2.0, None, 172_800_000_000_000), {"bool": "malformed", "text": "ok", "i32": "malformed", "f64": "malformed", "time": "out_of_range", "duration": "ok", "date": "malformed"}),
    "error": (cell("error", "#N/A"), {"bool": "malformed", "text": "ok", "i32": "malformed", "f64": "malformed", "time": "malformed", "duration": "malformed", "date": "malformed"}),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{d}', '{r}')" for k, (_, want) in _MATRIX.items() for d, r in want.items()) + ") AS t(kind, door, verdict)")
def typed_cell_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    doors = ["bool", "text", "i32", "f64", "time", "duration", "date"]
    rows = spark.createDataFrame([(k, (c["kind"], c["raw"], c["quoted"], c["num"], c["day"], c["nanos"], c["uncached"])) for k, (c, _) in _MATRIX.items()], "kind string, c struct<kind: string, raw: binary, quoted: boolean, num: double, day: date, nanos: long, uncached: boolean>")
    found = [F.struct(F.lit(d).alias("door"), F.coalesce(typed_door(F.col("c"), Column(0, Door(d)))["reason"], F.lit("ok")).alias("verdict")) for d in doors]
    return rows.select("kind", F.explode(F.array(*found)).alias("d")).select("kind", "d.*")


@query("SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(value AS DECIMAL(12,4))::DOUBLE END AS value FROM events")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered events as files of a folder, read as a stream that ends when all files are read."""
    from sluice.streaming.delimited import stream_delimited, write_stream

    base = work_path(spark, "stream")
    k = F.col("event_id")
    line = F.concat_ws(",", k.cast("string"), F.col("user_id").cast("string"), F.when(k % 11 == 0, "?").otherwise(F.col("value").cast("decimal(12,4)").cast("string")))
    sources = rendered(table(spark, sf_dir, "events"), k, line)
    # Text files: the writer ends each with a line's end of its own.
    sources.select(F.regexp_replace(F.col("_bytes").cast("string"), "\n$", "").alias("value")).write.mode("overwrite").text(f"{base}/in")
    plan = [Column(0, Door.I64, "event_id"), Column(1, Door.I64, "user_id"), Column(2, Door.F64, "value")]
    typed = stream_delimited(spark, f"{base}/in", plan, Dialect(has_header=False))
    write_stream(typed, f"{base}/values", f"{base}/problems", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/values").select("event_id", "user_id", "value")


from sluice.plans import edge_queries  # noqa: E402, F401  registers its queries
