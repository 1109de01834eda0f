"""Queries at the edges of framing, doors, constraints, sheets and suggestion, each with SQL that states the rule by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.constraints import Constraints, checked
from sluice.functions.doors import MDY, YMD, door
from sluice.functions.numbers import ALL, INDIAN, SEPARATOR_DETECT, TRAILING_SIGN, NumFormat
from sluice.operators.suggest import plan_of, suggest_source
from sluice.plans.catalogue import SOURCE_ROWS, query, quoted, rendered, table
from sluice.plans.columns import Column
from sluice.plans.dialect import Dialect
from sluice.plans.sample_packages import document, ods_bytes, row, stored, xlsx_bytes
from sluice.sources.delimited import Delimited
from sluice.sources.workbook import Range, SheetOptions, Workbook, typed_door
from sluice.types import AmbiguousColumn, CheckedColumn, DeclarationError, Door, NoColumn, StructuralFailure
from sluice.working import materialise, work_path

_PARTS, _LEAST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum"


# Framing


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, md5(t) AS same, CASE WHEN t = '' THEN 'empty' END AS reason, 2 + coalesce(sum(1 + len(regexp_extract_all(t, '\\r\\n|\\r|\\n'))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line,
row_number() OVER (ORDER BY doc_id) AS record FROM d)
SELECT cuts, doc_id, line, record, CASE WHEN reason IS NULL THEN same END AS same, reason FROM l, (VALUES (1), (3), (50)) AS c(cuts)""")
def frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quoted file of whole texts with their line ends, read in 1, 3 and 50 ranges."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(","), quoted(F.coalesce("text", F.lit(""))))
    path = work_path(spark, "one-file")
    rows = table(spark, sf_dir, "documents").select("doc_id", line.alias("value")).unionByName(spark.createDataFrame([(-1, "id,text")], "doc_id long, value string"))
    rows.repartition(1).sortWithinPartitions("doc_id").select("value").write.text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").first()
    before, least, out = spark.conf.get(_PARTS), spark.conf.get(_LEAST, None), None
    try:
        for cuts in (1, 3, 50):
            spark.conf.set(_PARTS, str(files["length"] // cuts + 1))
            spark.conf.set(_LEAST, str(cuts))  # else Spark cuts for as many tasks as there are cores
            typed = Delimited.open(spark, files["path"]).bind([Column("id", Door.I64, "doc_id"), Column("text")]).read()
            one = typed.frame.select(F.lit(cuts).alias("cuts"), F.col("doc_id.value").alias("doc_id"), F.col("_line").alias("line"), F.col("_record").alias("record"), F.md5(F.col("text.value").cast("binary")).alias("same"), F.col("text.reason").alias("reason"))
            one = materialise(one, "one-file-rows")
            out = one if out is None else out.unionByName(one)
    finally:
        spark.conf.set(_PARTS, before)
        spark.conf.unset(_LEAST) if least is None else spark.conf.set(_LEAST, least)
    return out


@query("SELECT s_suppkey, s_name || chr(8364) || chr(8220) || 'é' || chr(129) AS name FROM supplier")
def frame_1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that Windows-1252 and Latin-1 read apart, and one that Windows-1252 leaves open."""
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(","), F.col("s_name"), F.lit("\x80\x93é\x81"))
    sources = rendered(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), line, "id,name\n")
    sources = sources.select("_source", F.encode(F.col("_bytes").cast("string"), "ISO-8859-1").alias("_bytes"))
    return Delimited(sources, Dialect(encoding="windows-1252")).bind([Column("id", Door.I64, "s_suppkey"), Column("name")]).read().values()


@query("SELECT s_suppkey, s_name AS name, 'id' AS header FROM supplier")
def frame_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte order mark is no part of the header's first name, nor is one in the text cut out."""
    sources = rendered(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.concat(F.col("s_suppkey").cast("string"), F.lit(","), F.col("s_name")), "﻿id,name\n")
    reader = Delimited(sources)
    name = reader.header().names[0]
    typed = reader.bind([Column("id", Door.I64, "s_suppkey"), Column("name")]).read()
    return typed.values().withColumn("header", F.lit(name))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 5000 AS part, row_number() OVER (PARTITION BY o_orderkey // 5000 ORDER BY o_orderkey) AS i, o_orderkey % 5000 >= 4000 AS late FROM orders),
f AS (SELECT part, min(i) AS i FROM o WHERE late GROUP BY part)
SELECT o.part, o.k, (2 * o.i)::BIGINT AS line, CAST(NULL AS VARCHAR) AS kind FROM o LEFT JOIN f USING (part) WHERE o.i < coalesce(f.i, 1000000)
UNION ALL SELECT part, NULL, 2 * i, 'unclosed_quote' FROM f""")
def frame_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two lines each; the first key past 4000 of a source opens a quote that nothing closes."""
    k = F.col("o_orderkey")
    line = F.concat(k.cast("string"), F.lit(',"a\n'), F.when(k % SOURCE_ROWS >= 4000, "").otherwise('b"'))
    late = k % SOURCE_ROWS >= 4000
    first = F.min(F.when(late, k)).over(Window.partitionBy(F.floor(k / SOURCE_ROWS)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first")).where(F.col("first").isNull() | (k <= F.col("first")))
    reader = Delimited(rendered(rows, k, line, "id,x\n")).bind([Column("id", Door.I64)])
    part = F.substring_index("_source", "-", -1).cast("bigint").alias("part")
    intact = reader.read().frame.select(part, F.col("id.value").alias("k"), F.col("_line").alias("line"), F.lit(None).cast("string").alias("kind"))
    return intact.unionByName(reader.failures().select(part, F.lit(None).cast("long").alias("k"), "line", "kind"))


@query("""SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 2 END AS width, (CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS cut FROM events""")
def rows_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    line = F.concat(k.cast("string"), F.lit(","), F.col("event_type"), F.when(k % 3 == 0, ",x,y").otherwise(""))
    typed = Delimited(rendered(table(spark, sf_dir, "events"), k, line, "id,kind\n"), Dialect(long_rows="truncate")).bind([Column(0, Door.I64, "event_id"), Column("kind"), Column(1, Door.TEXT, "again")]).read()
    assert typed.problems().where("reason = 'long_row'").isEmpty()
    return typed.frame.select(F.col("event_id.value").alias("event_id"), F.col("kind.value").alias("kind"), F.col("_width").alias("width"), (F.col("_width") - F.col("_expected")).cast("bigint").alias("cut"))


@query("""WITH p AS (SELECT p_partkey // 5000 AS part, min(p_partkey) FILTER (WHERE p_partkey % 100 = 77) AS first FROM part GROUP BY ALL)
SELECT part, 'row_too_long' AS kind, (SELECT count(*) FROM part WHERE p_partkey // 5000 = p.part AND p_partkey < p.first)::BIGINT AS intact FROM p WHERE first IS NOT NULL""")
def frame_too_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(k.cast("string"), F.lit(","), F.when(k % 100 == 77, F.repeat(F.lit("x"), 300)).otherwise("x"))
    reader = Delimited(rendered(table(spark, sf_dir, "part"), k, line, "id,x\n"), Dialect(longest_record=200)).bind([Column("id", Door.I64)])
    intact = reader.read().frame.groupBy("_source").agg(F.count(F.lit(1)).alias("intact"))
    return reader.failures().join(intact, "_source", "left").select(F.substring_index("_source", "-", -1).cast("bigint").alias("part"), "kind", F.coalesce("intact", F.lit(0)).cast("bigint").alias("intact"))


# Doors


_KINDS = ("i8", "i16", "i32", "u8", "u16", "u32", "u64")
_LIMITS = {"i8": (-128, 127), "i16": (-32768, 32767), "i32": (-(1 << 31), (1 << 31) - 1), "u8": (0, 255), "u16": (0, 65535), "u32": (0, (1 << 32) - 1), "u64": (0, (1 << 64) - 1)}


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN n BETWEEN {a} AND {b} THEN n::VARCHAR WHEN n < 0 THEN '{'negativeNotAllowed' if a == 0 else 'tooSmall'}' ELSE 'tooLarge' END AS {d}" for d, (a, b) in _LIMITS.items()) + """
FROM (SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END)::HUGEINT * (o_orderkey * 7919 + 1) * (CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 100000 WHEN 3 THEN 10000000000 ELSE 100000000000000 END)::HUGEINT AS n FROM orders)""")
def door_integer_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of up to 24 digits and both signs at every width; some with groups."""
    k = F.col("o_orderkey")
    zeros = F.get(F.array(*(F.lit("0" * z) for z in (0, 2, 5, 10, 14))), (k % 5).cast("int"))
    text = F.concat(F.when(k % 3 == 0, "-").otherwise(""), (k * 7919 + 1).cast("string"), zeros)
    cells = table(spark, sf_dir, "orders").select("o_orderkey", *(door(Door(d), text).alias(d) for d in _KINDS))
    return cells.select("o_orderkey", *(F.coalesce(F.col(f"{d}.value").cast("string"), F.col(f"{d}.detail")).alias(d) for d in _KINDS))


@query("""SELECT event_id, CAST(CAST(value AS DECIMAL(12,4)) AS FLOAT)::DOUBLE AS value, CASE WHEN event_id % 2 = 0 THEN 'tooLarge' ELSE 'noDigits' END AS odd, (CAST(value AS DECIMAL(12,4))::DOUBLE / 100) AS share FROM events""")
def door_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("value").cast("decimal(12,4)").cast("string")
    odd = F.when(F.col("event_id") % 2 == 0, "4e38").otherwise("NaN")
    cells = table(spark, sf_dir, "events").select("event_id", door(Door.F32, text).alias("v"), door(Door.F32, odd).alias("o"), door(Door.F64, F.concat(text, F.lit(" %"))).alias("s"))
    return cells.select("event_id", F.col("v.value").cast("double").alias("value"), F.col("o.detail").alias("odd"), F.col("s.value").alias("share"))


@query("""SELECT event_id, epoch_us(date_trunc('minute', ts))::BIGINT AS american, epoch_us(ts)::BIGINT AS iso, epoch_us(date_trunc('day', ts))::BIGINT AS bare, 'out_of_range' AS late FROM events""")
def door_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Civil dates and times without a zone: a 12-hour clock, ISO with microseconds, no time, and an hour that there is not."""
    ts = F.col("ts").cast("timestamp_ntz")
    shown = {"american": (F.date_format(ts, "M/d/yyyy h:mm a"), MDY), "iso": (F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), YMD), "bare": (F.date_format(ts, "yyyy/M/d"), YMD), "late": (F.date_format(ts, "yyyy-MM-dd' 25:'mm"), YMD)}
    cells = table(spark, sf_dir, "events").select("event_id", *(door(Door.DATETIME, t, order=o).alias(k) for k, (t, o) in shown.items()))
    micros = lambda k: F.unix_micros(F.col(f"{k}.value").cast("timestamp")).alias(k)
    return cells.select("event_id", micros("american"), micros("iso"), micros("bare"), F.col("late.reason").alias("late"))


_DETECTED = """CASE k % 8
WHEN 0 THEN n WHEN 1 THEN n / 10 WHEN 2 THEN n / 10 WHEN 3 THEN n * 1000000 + 234567 WHEN 4 THEN n * 1000 + 234.5 WHEN 5 THEN n * 1000 + 234.5 WHEN 6 THEN 0.125 END"""


@query(f"""SELECT k, CAST({_DETECTED} AS DECIMAL(18,4))::VARCHAR AS value, CASE WHEN k % 8 = 7 THEN 'ambiguousSeparator' END AS detail FROM (SELECT o_orderkey AS k, (o_orderkey % 9 + 1)::DECIMAL(12,1) AS n FROM orders)""")
def door_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that tell their separators: none, one with other than three digits behind, two of one kind, both, a lone zero; and one that doesn't."""
    k = F.col("o_orderkey")
    n = (k % 9 + 1).cast("string")
    tenth = lambda s: F.concat(F.lit("0" + s), n)
    text = F.get(F.array(n, tenth("."), tenth(","), F.concat(n, F.lit(".234.567")), F.concat(n, F.lit(".234,5")), F.concat(n, F.lit(",234.5")), F.lit("0,125"), F.concat(n, F.lit(".234"))), (k % 8).cast("int"))
    cells = table(spark, sf_dir, "orders").select(k.alias("k"), door(Door.DECIMAL, text, form=NumFormat(flags=ALL | SEPARATOR_DETECT), precision=18, scale=4).alias("c"))
    return cells.select("k", F.col("c.value").cast("string").alias("value"), F.col("c.detail").alias("detail"))


@query("""SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * (p_partkey + 1000000))::BIGINT AS value, CASE p_partkey % 3 WHEN 0 THEN 'groupSize' WHEN 1 THEN 'unexpectedCharacter' END AS strange,
(p_partkey % 900 + 100)::INTEGER AS native FROM part""")
def door_signs_and_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a narrow no-break space with the sign behind; other spaces and wrong groups; native digits."""
    k = F.col("p_partkey")
    form = NumFormat(group=" ", decimal=",", flags=ALL | TRAILING_SIGN)
    text = F.concat(F.regexp_replace(F.format_number(k + 1_000_000, 0), ",", " "), F.when(k % 2 == 0, "-").otherwise("+"))
    odd = F.get(F.array(F.lit("1 23"), F.lit("1x234"), F.lit("1 234")), (k % 3).cast("int"))
    native = F.translate((k % 900 + 100).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    cells = table(spark, sf_dir, "part").select("p_partkey", door(Door.I64, text, form=form).alias("v"), door(Door.I64, odd, form=form).alias("o"), door(Door.I32, native, form=NumFormat(zero="٠")).alias("n"))
    return cells.select("p_partkey", F.col("v.value").alias("value"), F.col("o.detail").alias("strange"), F.col("n.value").alias("native"))


@query("""SELECT o_orderkey, n AS plain, CASE WHEN n < 100000 THEN n END AS both_western, n AS both_indian FROM (SELECT o_orderkey, (o_orderkey % 99000 + 1000)::BIGINT AS n FROM orders)""")
def door_group_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 99,999 both policies write alike."""
    n = F.col("o_orderkey") % 99000 + 1000
    shown = F.format_number(n, 0)
    cells = table(spark, sf_dir, "orders").select("o_orderkey", door(Door.I64, n.cast("string")).alias("p"), door(Door.I64, shown).alias("w"), door(Door.I64, shown, form=NumFormat(flags=ALL | INDIAN)).alias("i"))
    return cells.select("o_orderkey", F.col("p.value").alias("plain"), F.col("w.value").alias("both_western"), F.col("i.value").alias("both_indian"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'tooLarge' END AS detail, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN -9223372036854775808::HUGEINT ELSE (event_id * 86400 + 3600)::HUGEINT * 1000000000 END::BIGINT AS ns,
'outsideWindow' AS far, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 0.5 END::DECIMAL(18,2) AS half, CASE WHEN event_id % 2 = 0 THEN 'tooPrecise' END AS lost FROM events""")
def durations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations past 64-bit nanoseconds, the very last one, instants of 38 digits, and percentages that a scale can't hold."""
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "PT9999999999999999999S").when(k % 4 == 1, "-P106751DT23H47M16.854775808S").otherwise(F.concat(F.lit("P"), k.cast("string"), F.lit("DT1H")))
    cells = table(spark, sf_dir, "events").select("event_id", door(Door.DURATION, text).alias("d"), door(Door.UNIX, F.lit("9" * 38), precision="ns").alias("u"), door(Door.DECIMAL, F.when(k % 2 == 0, "0.5%").otherwise("50%"), precision=18, scale=2).alias("p"))
    return cells.select("event_id", F.col("d.detail").alias("detail"), F.col("d.value").alias("ns"), F.col("u.detail").alias("far"), F.col("p.value").alias("half"), F.col("p.detail").alias("lost"))


# Constraints


@query("""SELECT event_id, v AS value, CASE WHEN d < 20.0000 THEN 'minimum' END AS low, CASE WHEN d >= 50.0001 THEN 'exclusiveMaximum' END AS high, CASE WHEN d % 0.0025 <> 0 THEN 'multipleOf' END AS step,
round(d * 4, 0) / 4 AS mid, floor(d / 0.5) * 0.5 AS down, CASE WHEN d * 4 % 2 IN (0.5, 1.5) THEN NULL ELSE d * 4 % 1 <> 0 END AS moved, 0.000000000001::DOUBLE AS tiny FROM
(SELECT event_id, CAST(value AS DECIMAL(12,4))::DOUBLE AS v, CAST(value AS DECIMAL(12,4)) AS d FROM events)""")
def constraints_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and steps over reals, whose own digits come through; ties go to the even step (left out of ``moved`` and ``mid`` here)."""
    t = F.col("value").cast("decimal(12,4)").cast("string")
    c = lambda rules, text=t: checked(door(Door.F64, text), text.cast("binary"), Door.F64, rules)
    cells = table(spark, sf_dir, "events").select("event_id", t.cast("decimal(12,4)").alias("d"), c(Constraints(minimum="20")).alias("l"), c(Constraints(exclusive_maximum="50.0001")).alias("h"), c(Constraints(multiple_of="0.0025")).alias("s"), c(Constraints(multiple_of="0.25", rounding="midpoint")).alias("m"), c(Constraints(multiple_of="0.5", rounding="floor")).alias("f"), c(Constraints(minimum="0"), F.lit("0.000000000001")).alias("t"))
    tie = (F.col("d") * 8) % 2 == 1
    rounded = F.when(tie, F.round(F.col("d") * 4, 0) / 4).otherwise(F.col("m.value"))
    return cells.select("event_id", F.col("l.value").alias("value"), F.col("l.keyword").alias("low"), F.col("h.keyword").alias("high"), F.col("s.keyword").alias("step"), rounded.cast("double").alias("mid"), F.col("f.value").alias("down"), F.when((F.col("d") * 4) % 2 == 0.5, None).when((F.col("d") * 4) % 2 == 1.5, None).otherwise(F.col("m.adjusted")).alias("moved"), F.col("t.value").alias("tiny"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'empty' WHEN p_partkey % 5 = 1 THEN 'empty' WHEN p_partkey % 5 = 2 THEN 'malformed' WHEN p_size < 25 THEN 'violation' END AS reason,
CASE WHEN p_partkey % 5 >= 3 THEN p_size END AS value, CASE WHEN p_partkey % 5 >= 3 AND p_size < 25 THEN 'minimum' END AS keyword, CASE WHEN p_partkey % 5 >= 3 AND p_size < 25 THEN length(p_size::VARCHAR) END AS span,
CASE WHEN p_partkey % 5 = 0 THEN 'token' ELSE 'cell' END AS origin, 'enum' AS nothing, CASE WHEN p_size % 2 = 0 THEN p_size WHEN (p_size + 1) // 2 % 2 = 0 THEN p_size + 1 ELSE p_size - 1 END AS even FROM part""")
def constraints_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and blanks are never a violation; a violated cell has its value as cast; an empty enumeration lets nothing through; ties go to even steps."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    cell = F.when(k % 5 == 0, "NA").when(k % 5 == 1, " ").when(k % 5 == 2, "x1").otherwise(size)
    line = F.concat_ws(",", k.cast("string"), cell, size)
    plan = [Column("id", Door.I64, "p_partkey"), Column("a", Door.I32, tokens=("NA",), constraints=Constraints(minimum="25")), Column("b", Door.TEXT, constraints=Constraints(enum=())), Column("b", Door.I32, "c", constraints=Constraints(multiple_of="2", rounding="midpoint"))]
    t = Delimited(rendered(table(spark, sf_dir, "part"), k, line, "id,a,b\n")).bind(plan).read().frame
    return t.select(F.col("p_partkey.value").alias("p_partkey"), F.col("a.reason").alias("reason"), F.col("a.value").alias("value"), F.col("a.keyword").alias("keyword"), F.when(F.col("a.keyword").isNotNull(), F.col("a.len")).cast("bigint").alias("span"), F.col("a.origin").alias("origin"), F.col("b.keyword").alias("nothing"), F.col("c.value").alias("even"))


@query("""SELECT * FROM (VALUES ('text with a minimum', 'DeclarationError'), ('a number with a length', 'DeclarationError'), ('a date with an enumeration', 'DeclarationError'), ('a bound that is no number', 'DeclarationError'), ('a step of 0', 'DeclarationError'), ('a negative length', 'DeclarationError'),
('a rounding that there is not', 'DeclarationError'), ('a value of a checked column', 'CheckedColumn'), ('a name that occurs twice', 'AmbiguousColumn'), ('a name that is not there', 'NoColumn'), ('an ordinal past the header', 'PlanError'), ('a retired flag', 'DeclarationError'), ('the same separators', 'DeclarationError'), ('a package of 0 bytes', 'DeclarationError')) AS t(what, error)""")
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan or a dialect cannot have is told before anything is read."""
    one = Delimited.from_bytes(spark, b"a,b,a\n1,2,3\n")
    tries = {
        "text with a minimum": lambda: Constraints(minimum="1").check(Door.TEXT),
        "a number with a length": lambda: Constraints(min_length=1).check(Door.I32),
        "a date with an enumeration": lambda: Constraints(enum=("x",)).check(Door.DATE),
        "a bound that is no number": lambda: Constraints(maximum="ten").check(Door.F64),
        "a step of 0": lambda: Constraints(multiple_of="0").check(Door.F64),
        "a negative length": lambda: Constraints(max_length=-1).check(Door.TEXT),
        "a rounding that there is not": lambda: Constraints(multiple_of="1", rounding="up").check(Door.I32),
        "a value of a checked column": lambda: one.bind([Column(0, Door.I32, constraints=Constraints(minimum="0"))]).read().value("a"),
        "a name that occurs twice": lambda: one.bind([Column("a")]),
        "a name that is not there": lambda: one.bind([Column("A")]),
        "an ordinal past the header": lambda: one.bind([Column(3)]),
        "a retired flag": lambda: NumFormat(flags=ALL | 256),
        "the same separators": lambda: NumFormat(decimal=",", group=","),
        "a package of 0 bytes": lambda: Workbook.open(spark, "nowhere", 0),
    }
    told = []
    for what, attempt in tries.items():
        try:
            attempt()
            told.append((what, None))
        except (DeclarationError, CheckedColumn, AmbiguousColumn, NoColumn) as e:
            told.append((what, type(e).__name__))
    return spark.createDataFrame(told, "what string, error string")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS raw, (CASE WHEN c_custkey % 3 = 0 THEN 'malformed' END) AS reason, (c_custkey // 5000 * 0 + row_number() OVER (PARTITION BY c_custkey // 5000 ORDER BY c_custkey) + 1)::BIGINT AS line, 2::BIGINT AS first_b FROM customer""")
def cells_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that a cell was judged by, its row's line, and the first column of a name that occurs twice."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    line = F.concat_ws(",", k.cast("string"), text, F.lit("2"), F.lit("3"))
    reader = Delimited(rendered(table(spark, sf_dir, "customer"), k, line, "id,a,b,b\n"))
    first = reader.header().ordinal("b")
    t = reader.bind([Column("id", Door.I64), Column("a", Door.I32), Column(first, Door.I64, "b")]).read().frame
    return t.select(F.col("id.value").alias("c_custkey"), F.col("a.raw").cast("string").alias("raw"), F.col("a.reason").alias("reason"), F.col("_line").alias("line"), F.col("b.value").alias("first_b"))


# Workbooks


@query("""SELECT k, i,
CASE WHEN i = 'price' THEN 'fractionNotAllowed' WHEN i = 'whole' AND n BETWEEN -128 AND 127 THEN n::VARCHAR WHEN i = 'whole' AND n < 0 THEN 'tooSmall' WHEN i = 'whole' THEN 'tooLarge' WHEN i = 'huge' THEN 'tooLarge' ELSE 'tooSmall' END AS i8,
CASE WHEN i = 'price' THEN 'fractionNotAllowed' WHEN i = 'whole' AND n >= 0 THEN n::VARCHAR WHEN i IN ('whole', 'low') THEN 'negativeNotAllowed' ELSE 'tooLarge' END AS u64,
CASE WHEN i IN ('huge', 'low') THEN 'tooLarge' ELSE 'ok' END AS f32,
CASE WHEN i = 'price' THEN (n + 0.25)::DECIMAL(18,2)::VARCHAR WHEN i = 'whole' THEN n::DECIMAL(18,2)::VARCHAR ELSE 'tooLarge' END AS dec,
CASE WHEN i = 'low' OR n < 0 AND i <> 'huge' THEN 'negativeNotAllowed' WHEN i = 'huge' OR n >= 2958466 THEN 'timeFieldOutOfRange' WHEN i = 'price' THEN '21600000000000' ELSE '0' END AS clock,
CASE WHEN i = 'price' THEN 'notWhole' WHEN i = 'whole' THEN n::VARCHAR ELSE 'outsideWindow' END AS unix,
CASE i WHEN 'price' THEN n || '.25' WHEN 'whole' THEN n::VARCHAR WHEN 'huge' THEN '1.5e300' ELSE '-1.5e300' END AS shown
FROM (SELECT o_orderkey AS k, ((o_orderkey * 53) % 600 - 200 + CASE WHEN o_orderkey % 7 = 0 THEN 3000000 ELSE 0 END)::BIGINT AS m, CASE o_orderkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'whole' WHEN 2 THEN 'huge' ELSE 'low' END AS i, CASE WHEN o_orderkey % 4 = 0 THEN abs(m) ELSE m END AS n FROM orders)""")
def typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of workbook cells at doors of all kinds: in range, with a fraction, and past every range."""
    k = F.col("o_orderkey")
    m = (k * 53) % 600 - 200 + F.when(k % 7 == 0, 3_000_000).otherwise(0)
    i = F.get(F.array(*map(F.lit, ("price", "whole", "huge", "low"))), (k % 4).cast("int"))
    shown = F.when(i == "price", F.concat(F.abs(m).cast("string"), F.lit(".25"))).when(i == "whole", m.cast("string")).when(i == "huge", "1.5e300").otherwise("-1.5e300")
    cell = F.struct(F.lit("number").alias("kind"), shown.cast("binary").alias("raw"), F.lit(False).alias("quoted"), shown.cast("double").alias("num"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("bigint").alias("nanos"), F.lit(False).alias("uncached"))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), i.alias("i"), cell.alias("c"))
    doors = {"i8": Column(0, Door.I8), "u64": Column(0, Door.U64), "f32": Column(0, Door.F32), "dec": Column(0, Door.DECIMAL, decimal=(18, 2)), "clock": Column(0, Door.TIME), "unix": Column(0, Door.UNIX, precision="s"), "shown": Column(0, Door.TEXT)}
    judged = rows.select("k", "i", *(typed_door(F.col("c"), d).alias(n) for n, d in doors.items()))
    told = lambda n: F.coalesce(F.when(F.col(f"{n}.reason").isNull(), F.lit("ok") if n == "f32" else F.unix_seconds(f"{n}.value").cast("string") if n == "unix" else F.col(f"{n}.value").cast("string")), F.col(f"{n}.detail")).alias(n)
    return judged.select("k", "i", *map(told, doors))


_SPLIT = 2_000


@query(f"""SELECT c_custkey AS id, c_name AS shared, DATE '2024-01-01' + (c_custkey % 300)::INTEGER AS day, ((c_custkey % 24) * 3600000000000)::BIGINT AS clock, ((c_custkey % 100) * 3600000000000)::BIGINT AS elapsed, CASE WHEN c_custkey % 9 = 0 THEN '#N/A' ELSE 'x' END AS error,
'uncached' AS formula, (c_custkey // {_SPLIT}) % 2 = 1 AS later FROM customer""")
def sheet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared strings, styles of dates, times and elapsed times, errors and formulas without results; packages of both date systems side by side."""
    from datetime import date, timedelta
    from xml.sax.saxutils import escape

    import pyarrow as pa

    def packages(batches):
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                later = part % 2 == 1
                lines = []
                for i, r in enumerate(rows):
                    k, n = r["k"], i + 1
                    serial = (date(2024, 1, 1) + timedelta(days=k % 300) - (date(1904, 1, 1) if later else date(1899, 12, 30))).days
                    error = '<c r="F{0}" t="e"><v>#N/A</v></c>' if k % 9 == 0 else '<c r="F{0}" t="str"><v>x</v></c>'
                    lines.append(f'<row r="{n}"><c r="A{n}"><v>{k}</v></c><c r="B{n}" t="s"><v>{i}</v></c><c r="C{n}"><v>{serial}</v></c><c r="D{n}" s="2"><v>{(k % 24) / 24 + (2 if later else 0)!r}</v></c><c r="E{n}" s="3"><v>{(k % 100) / 24!r}</v></c>{error.format(n)}<c r="G{n}"><f>1+1</f></c></row>')
                yield pa.RecordBatch.from_pydict({"_source": [f"part-{part:08d}"], "_bytes": [xlsx_bytes([], raw="".join(lines), date1904=later, strings=[f"<t>{escape(r['n'])}</t>" for r in rows])]})

    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / _SPLIT).alias("part"), F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")).alias("r"))
    sources = rows.groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rows")).mapInArrow(packages, "_source string, _bytes binary")
    plan = [Column(0, Door.I64, "id"), Column(1, Door.TEXT, "shared"), Column(2, Door.DATE, "day"), Column(3, Door.TIME, "clock"), Column(4, Door.DURATION, "elapsed"), Column(5, Door.TEXT, "error"), Column(6, Door.I32, "formula")]
    t = Workbook(materialise(sources, "packages")).read("Data", plan, SheetOptions(has_header=False)).frame
    return t.select(*(F.col(f"{c}.value").alias(c) for c in ("id", "shared", "day", "clock", "elapsed", "error")), F.col("formula.origin").alias("formula"), (F.substring_index("_source", "-", -1).cast("bigint") % 2 == 1).alias("later"))


@query("""SELECT c_custkey AS id, c_name AS name FROM (SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey // 5000 ORDER BY c_custkey) AS i FROM customer) WHERE i BETWEEN 2 AND 99""")
def sheet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 4 to 103 and columns C to D of a sheet: one row is skipped, the next one's names are the header."""
    import pyarrow as pa

    def packages(batches):
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = [["title"], [], ["x", "y", "z"], [None, None, "skipped"], [None, None, "id", "name", "more"], [None, None, -1.0, "none", "m"]][:5]
                yield pa.RecordBatch.from_pydict({"_source": [f"part-{part:08d}"], "_bytes": [xlsx_bytes(body + [["w", 0.0, float(r["k"]), r["n"], "m"] for r in rows])]})

    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / SOURCE_ROWS).alias("part"), F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")).alias("r"))
    sources = rows.groupBy("part").agg(F.array_sort(F.collect_list("r")).alias("rows")).mapInArrow(packages, "_source string, _bytes binary")
    options = SheetOptions(skip=1, header_row=0, range=Range.parse("C4:D104"))
    values = Workbook(sources).read("Data", [Column("id", Door.I64), Column("name")], options).frame
    return values.where("_record > 0").select(F.col("id.value").alias("id"), F.col("name.value").alias("name"))


@query("""SELECT * FROM (VALUES ('a.xlsx', 0, 'Data', false, 'xlsx', 1904, NULL), ('a.xlsx', 1, 'Hidden', true, 'xlsx', 1904, NULL), ('b.ods', 0, 'Data', false, 'ods', 1900, NULL), ('c.numbers', 0, 'Sheet 1', true, 'numbers', 1900, NULL), ('d.txt', NULL, NULL, NULL, NULL, NULL, 'not_a_zip'), ('e.xls', NULL, NULL, NULL, NULL, NULL, 'encrypted'), ('f.xlsx', NULL, NULL, NULL, NULL, NULL, 'container'), ('g.xlsb', NULL, NULL, NULL, NULL, NULL, 'not_a_workbook'), ('h.big', NULL, NULL, NULL, NULL, NULL, 'too_large')) AS t(_source, sheet, name, hidden, format, epoch, failure)""")
def sheet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of all formats, and packages that cannot be read, each with its failure."""
    import io
    import zipfile

    binary = io.BytesIO()
    with zipfile.ZipFile(binary, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.bin", b"\x83\x01")
    packages = {"a.xlsx": xlsx_bytes([["a"]], [("Hidden", "hidden")], date1904=True), "b.ods": ods_bytes([["a"]]), "c.numbers": document([row(0, [stored(2, dec="1")])], hidden=1), "d.txt": b"a,b\n", "e.xls": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(8), "f.xlsx": xlsx_bytes([["a"]])[:-30], "g.xlsb": binary.getvalue()}
    sources = Workbook.from_bytes(spark, packages).sources.unionByName(spark.createDataFrame([("h.big", None)], "_source string, _bytes binary"))
    return Workbook(sources).sheets()


@query("SELECT n_nationkey::BIGINT AS k, (n_nationkey * 1.25)::DOUBLE AS amount, 'é text' AS name, (n_nationkey::BIGINT * 3600 % 86400) * 1000000000 AS clock, n_nationkey % 2 = 0 AS flag, CASE WHEN n_nationkey = 7 THEN 'malformed' END AS odd FROM nation")
def sheet_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Numbers table with 128-bit decimals (a cell without a number too), shared text, times of day and booleans."""
    import struct

    nan = bytes([5, 2]) + bytes(6) + struct.pack("<I", 1) + (0x7C << 120).to_bytes(16, "little")
    rows = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    cells = [row(k, [stored(2, dec=str(k)), stored(10, dec=f"{k * 125}e-2"), stored(3, ids=[(3, 2)]), stored(5, sec=k * 3600.0, ids=[(15, 7)]), stored(6, dbl=float(k % 2 == 0)), nan if k == 7 else stored(2, dec="1")]) for k in rows]
    plan = [Column(0, Door.I64, "k"), Column(1, Door.F64, "amount"), Column(2, Door.TEXT, "name"), Column(3, Door.TIME, "clock"), Column(4, Door.BOOL, "flag"), Column(5, Door.F64, "odd")]
    t = Workbook.from_bytes(spark, document(cells)).read(0, plan, SheetOptions(has_header=False)).frame
    return t.select(*(F.col(f"{c}.value").alias(c) for c in ("k", "amount", "name", "clock", "flag")), F.col("odd.reason").alias("odd"))


@query("""SELECT r.r AS line, (r.r * 0 + c.c)::INTEGER AS col, 7.0::DOUBLE AS value FROM (SELECT unnest(range(1, 4)) AS r) r, (SELECT unnest(range(0, 3)) AS c) c""")
def sheet_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows and columns of a sheet; a million empty ones behind them are counted only."""
    raw = '<table:table-row table:number-rows-repeated="3"><table:table-cell office:value-type="float" office:value="7" table:number-columns-repeated="3"/><table:table-cell table:number-columns-repeated="16381"/></table:table-row><table:table-row table:number-rows-repeated="1048570"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    t = Workbook.from_bytes(spark, ods_bytes([], raw=raw)).read(0, [Column(i, Door.F64) for i in range(4)], SheetOptions(has_header=False)).frame
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.col(f"c{i}.value").alias("value")) for i in range(4)))).alias("x")
    return t.select(F.col("_line").alias("line"), cells).select("line", "x.*").where("value IS NOT NULL")


# Suggestion


# Which spelling of a number names which notation. Shapes are rendered from customers' keys; the first word is
# the door, then the notations that are left open.
_SHAPES = {
    "whole": ("i32", "resolved", ""),
    "comma_groups": ("i32", "resolved", "point"),
    "dot_groups": ("i32", "resolved", "comma"),
    "comma_then_dot": ("f64", "resolved", "point"),
    "dot_then_comma": ("f64", "resolved", "comma"),
    "comma_and_two": ("f64", "resolved", "comma"),
    "dot_and_two": ("f64", "resolved", ""),
    "comma_and_three": ("i32", "ambiguous", "point comma"),
    "dot_and_three": ("f64", "ambiguous", "point comma"),
    "zero_comma_three": ("f64", "resolved", "comma"),
    "zero_dot_three": ("f64", "resolved", ""),
    "four_comma_three": ("f64", "resolved", "comma"),
    "both_decimals": ("text", "unresolved", ""),
    "three_settled": ("f64", "resolved", "point"),
    "three_conflict": ("f64", "ambiguous", "point comma"),
    "padded": ("text", "resolved", ""),
    "past_64_bits": ("text", "resolved", ""),
    "past_with_exponent": ("f64", "resolved", ""),
    "year_first": ("date_ordered", "resolved", "ymd"),
    "either_order": ("date_ordered", "ambiguous", "mdy dmy"),
    "day_first": ("date_ordered", "resolved", "dmy"),
    "iso": ("date", "resolved", ""),
    "instant": ("timestamp", "resolved", ""),
    "flag": ("bool", "resolved", ""),
    "key": ("uuid", "resolved", ""),
    "blank": ("text", "unresolved", ""),
    "words": ("text", "resolved", ""),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{d}', '{s}', '{p}')" for n, (d, s, p) in _SHAPES.items()) + ") AS t(name, door, status, param)")
def suggest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each shape of numbers, dates and texts, read back from delimited text."""
    k = F.col("c_custkey")
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    one = (k % 9 + 1).cast("string")
    odd = k % 2 == 1
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 12 + 30 * (k % 11)).cast("int"))
    low = F.concat((k % 12 + 1).cast("string"), F.lit("/"), (k % 12 + 1).cast("string"), F.lit("/2024"))
    shapes = {
        "whole": k.cast("string"),
        "comma_groups": F.concat(one, F.lit(",234,"), three),
        "dot_groups": F.concat(one, F.lit(".234."), three),
        "comma_then_dot": F.concat(one, F.lit(",234.5")),
        "dot_then_comma": F.concat(one, F.lit(".234,5")),
        "comma_and_two": F.concat(one, F.lit(",50")),
        "dot_and_two": F.concat(one, F.lit(".50")),
        "comma_and_three": F.concat(one, F.lit(","), three),
        "dot_and_three": F.concat(one, F.lit("."), three),
        "zero_comma_three": F.concat(F.lit("0,"), three),
        "zero_dot_three": F.concat(F.lit("0."), three),
        "four_comma_three": F.concat(one, F.lit("234,"), three),
        "both_decimals": F.when(odd, F.concat(one, F.lit(",5"))).otherwise(F.concat(one, F.lit(".5"))),
        "three_settled": F.when(odd, F.concat(one, F.lit(","), three)).otherwise(F.concat(one, F.lit(".5"))),
        "three_conflict": F.when(odd, F.concat(one, F.lit(","), three)).otherwise(F.concat(one, F.lit("."), three)),
        "padded": F.concat(F.lit("00"), one),
        "past_64_bits": F.concat(one, F.lit("0" * 19), one),
        "past_with_exponent": F.concat(one, F.lit("e19")),
        "year_first": F.date_format(day, "yyyy/M/d"),
        "either_order": low,
        "day_first": F.when(odd, low).otherwise("31/1/2024"),
        "iso": day.cast("string"),
        "instant": F.concat(day.cast("string"), F.lit("T10:00:00Z")),
        "flag": F.when(odd, "yes").otherwise("off"),
        "key": F.md5(k.cast("string").cast("binary")),
        "blank": F.lit(" "),
        "words": F.col("c_name"),
    }
    line = F.concat_ws(",", *(quoted(shapes[n]) for n in _SHAPES))
    found, more = suggest_source(Delimited(rendered(table(spark, sf_dir, "customer"), k, line, ",".join(_SHAPES) + "\n")), 500)
    return spark.createDataFrame([(n, s.door.value, s.status, " ".join(s.param)) for n, s in found.items()], "name string, door string, status string, param string")


@query("""SELECT * FROM (VALUES ('amount', 'f64', 'resolved', 'f64'), ('day', 'text', 'resolved', 'text'), ('id', 'i32', 'resolved', 'i32'), ('name', 'text', 'resolved', 'text'), ('mixed', 'f64', 'resolved', 'f64'), ('broken', 'StructuralFailure', '', '')) AS t(name, door, status, planned)""")
def suggest_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed numbers of a sheet fit every notation by their value, beside text cells that settle it; a sheet that breaks ahead of the sample raises."""
    from datetime import date

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy("c_custkey").limit(100).collect()  # the sample of a suggestion
    cells = [["id", "name", "amount", "day", "mixed"]] + [[float(r["c_custkey"]), r["c_name"], r["c_acctbal"] + 0.25, date(2024, 1, 1), "1.234,5" if i % 2 else 1.5] for i, r in enumerate(rows)]
    found, _ = Workbook.from_bytes(spark, xlsx_bytes(cells)).suggest()
    plan = {c.name: c.door.value for c in plan_of(found)}
    out = [(n, s.door.value, s.status, plan[n]) for n, s in found.items()]
    try:
        Workbook.from_bytes(spark, b"no package").suggest()
    except StructuralFailure as e:
        out.append(("broken", type(e).__name__, "", ""))
    return spark.createDataFrame(out, "name string, door string, status string, planned string")
