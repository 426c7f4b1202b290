"""Every operator as a query on the star-schema tables, each with its SQL twin.

The SQL states the definition in the plainest way (compare all codes, or join a
key table with itself); the Spark side is the engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits as fb
from .functions.layout import section_masks
from .operators.formatting import format_keys, format_pairs
from .operators.cell_joins import rows_per_code as cell_rows_of
from .operators.groups import emits_histogram, group_sizes, groups, key_volume, size_histogram
from .operators.keys import block_of, keyed
from .operators.pairs import pairs
from .operators.records import HOT_ROWS, code_counts, record_pair_counts, record_pairs
from .plans.cost import cost_profile
from .plans.strategy import Strategy, strategy
from .plans.timing import TIMING_SCHEMA, timing_profile, timing_summary
from .session import shared_folder, shuffle_partitions
from .sources.buckets import stored_pairs, write_codes
from .sources.encoders import bit_width, fold_signs, position_bitmap, sign_text, text_digests
from .sources.reports import append_report, read_report
from .sources.text import read_bitstrings, scan_bitstrings, write_bitstrings
from .sources.universe import bit_universe, payload_length, with_payload

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIMS = 64          # components of an embedding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- code tables: (id, x), one row per record -------------------------------

def emb(b: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), fold_signs("embedding", DIMS, b).alias("x"))


def emb_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), sign_text("embedding", DIMS).alias("x"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("o_orderdate") - 1
    df = position_bitmap(table(spark, sf_dir, "orders"), "o_custkey", month, 12)
    return df.withColumnRenamed("o_custkey", "id")


def ship_window(lines: DataFrame) -> tuple[int, int]:
    """First month of shipping, counted from year 0, and how many there are, an even number.

    One aggregated row, by a scan of one column while the query is built.
    """
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    low, high = lines.agg(F.min(month), F.max(month)).first()
    if low is None:
        return 0, 2
    months = high - low + 1
    return low, months + months % 2


def shipping_coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Shipping months of every order as a bitmap, and its width."""
    lines = table(spark, sf_dir, "lineitem")
    low, months = ship_window(lines)
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - low
    return position_bitmap(lines, "l_orderkey", month, months).withColumnRenamed("l_orderkey", "id"), months


def shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipping_coded(spark, sf_dir)[0]


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight pooled signs, nine characters apart, in a text code of 72 characters."""
    bits = fb.long_to_bits(fold_signs("embedding", DIMS, 8), 8)
    df = table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("id"), F.regexp_replace(bits, "(.)", "$100000000").alias("x"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_digests(table(spark, sf_dir, "documents"), "text", 16)
    return df.select(F.col("doc_id").alias("id"), "x")


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("x"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations")
    return df.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("conv_id").alias("x"), "role")


def even_width(df: DataFrame) -> int:
    """Bits of the largest code, rounded up to an even number."""
    b = bit_width(df, "x")
    return b + b % 2


def _fold_sql(b: int) -> str:
    run = DIMS // b
    bits = []
    for i in range(b):
        total = " + ".join(f"embedding[{i * run + k + 1}]::DOUBLE" for k in range(run))
        bits.append(f"CASE WHEN {total} > 0 THEN {1 << (b - 1 - i)} ELSE 0 END")
    value = " + ".join(f"({bit})" for bit in bits)
    return f"SELECT vec_id AS id, ({value})::BIGINT AS x FROM embeddings"


_SIGNS = " || ".join(
    f"CASE WHEN embedding[{i + 1}] > 0 THEN '1' ELSE '0' END" for i in range(DIMS)
)
_SHIP_MONTH = "(year(l_shipdate) * 12 + month(l_shipdate) - 1)"
_SHIP_WINDOW = (f"(SELECT low, n + n % 2 AS b FROM (SELECT min({_SHIP_MONTH}) AS low, "
                f"max({_SHIP_MONTH}) - min({_SHIP_MONTH}) + 1 AS n FROM lineitem))")

CODE_SQL = {
    "emb8": _fold_sql(8),
    "emb16": _fold_sql(16),
    "emb64": f"SELECT vec_id AS id, {_SIGNS} AS x FROM embeddings",
    "emb72": f"SELECT id, regexp_replace(lpad(bin(x), 8, '0'), '(.)', '\\100000000', 'g') AS x FROM ({_fold_sql(8)})",
    "months": (
        "SELECT o_custkey AS id, bit_or(1::BIGINT << (month(o_orderdate) - 1)::INT) AS x "
        "FROM orders GROUP BY o_custkey"
    ),
    "shipping": (
        "SELECT l_orderkey AS id, string_agg(CASE WHEN seen THEN '1' ELSE '0' END, '' "
        "ORDER BY pos DESC) AS x FROM (SELECT l_orderkey, pos, "
        f"bool_or(pos = {_SHIP_MONTH} - low) AS seen FROM lineitem, (SELECT low, unnest(range(b)) AS pos "
        f"FROM {_SHIP_WINDOW}) GROUP BY l_orderkey, pos) GROUP BY l_orderkey"
    ),
    "digest": (
        "SELECT doc_id AS id, ('0x' || substr(md5(text), 1, 4))::BIGINT AS x "
        "FROM documents WHERE text IS NOT NULL"
    ),
    "orders": "SELECT o_orderkey AS id, o_orderkey AS x FROM orders",
    "turns": "SELECT concat_ws('/', conv_id, turn) AS id, conv_id AS x, role FROM conversations",
}
CODES: dict[str, Query] = {
    "emb8": partial(emb, 8),
    "emb16": partial(emb, 16),
    "emb64": emb_text,
    "emb72": spread,
    "months": months,
    "shipping": shipping,
    "digest": digest,
    "orders": order_keys,
    "turns": turns,
}
WIDTH = {"emb8": 8, "emb16": 16, "emb64": 64, "emb72": 72, "months": 12, "digest": 16}


def coded(code: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A code table and the width of its codes."""
    if code == "shipping":
        return shipping_coded(spark, sf_dir)
    df = CODES[code](spark, sf_dir)
    return df, WIDTH.get(code) or even_width(df)


def cell_partitions(code: str, s: Strategy, rows_per_code: int, spark: SparkSession, sf_dir: str) -> int:
    """Partitions for codes that become so many rows each: the table has a row for a code at least, and its footers tell how many."""
    source = {"shipping": "lineitem", "months": "orders", "orders": "orders"}[code]
    needed = shuffle_partitions(table(spark, sf_dir, source).count(), rows_per_code, len(s.layout.words))
    return max(needed, spark.sparkContext.defaultParallelism)


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def flat(df: DataFrame, *rest: str) -> DataFrame:
    """The fields of ``key`` as columns, integers as BIGINT."""
    df = df.select("key.*", *rest)
    return df.select([F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c)
                      for c, t in df.dtypes])


# -- the key table of a strategy in SQL --------------------------------------

def _grid_sql(b: int, u: int) -> str:
    half = b // 2

    def cell(w: str) -> str:
        return f"CASE WHEN {w} = {half} THEN {w} // {u} ELSE {w} // {u} + 1 END"

    return f"""
        w AS (SELECT id, x, bit_count(x >> {half})::BIGINT AS wl,
                     bit_count(x & {(1 << half) - 1})::BIGINT AS wr FROM c),
        h AS (SELECT id, x, wl, wr, {cell('wl')} AS i, {cell('wr')} AS j FROM w),
        k AS (SELECT i AS gi, j AS gj, id, x FROM h
              UNION ALL SELECT i - 1, j, id, x FROM h WHERE i > 1 AND wl = (i - 1) * {u}
              UNION ALL SELECT i, j - 1, id, x FROM h WHERE j > 1 AND wr = (j - 1) * {u})"""


def key_sql(code: str, s: Strategy) -> tuple[str, list[str]]:
    """``WITH`` clause that defines ``c`` (records) and ``k`` (keyed records); key columns."""
    start = f"WITH c AS ({CODE_SQL[code]}),"
    if s.name == "serial":
        return f"{start} k AS (SELECT 1::BIGINT AS one, id, x FROM c)", ["one"]
    if s.name == "hashing":
        return (
            f"{start} k AS (SELECT least(x % {s.param}, j) AS lo, greatest(x % {s.param}, j) AS hi,"
            f" id, x FROM c, range({s.param}) t(j))",
            ["lo", "hi"],
        )
    if s.name == "group":
        return start + _grid_sql(s.b, s.param), ["gi", "gj"]
    if s.name == "maxparallel":
        return (
            f"{start} k AS (SELECT p, x & ~(1::BIGINT << p::INT) AS masked, id, x "
            f"FROM c, range({s.b}) t(p))",
            ["p", "masked"],
        )
    masks = ", ".join(f"({m}::BIGINT, {mask}::BIGINT)"
                      for m, mask in enumerate(section_masks(s.b, s.param)))
    return (
        f"{start} k AS (SELECT m, x & ~mask AS rest, id, x FROM c, (VALUES {masks}) t(m, mask))",
        ["m", "rest"],
    )


NEIGHBOURS = "{a}.x < {z}.x AND bit_count(xor({a}.x, {z}.x)) = 1"


def pair_sql(code: str, columns: str = "l.x AS x_lo, r.x AS x_hi") -> str:
    on = NEIGHBOURS.format(a="l", z="r")
    if code in ("emb64", "emb72", "shipping"):
        on = "l.x < r.x AND hamming(l.x, r.x) = 1"
    return (
        f"WITH c AS ({CODE_SQL[code]}), d AS (SELECT DISTINCT x FROM c) "
        f"SELECT {columns} FROM d l JOIN d r ON {on}"
    )


def raw_sql(code: str, s: Strategy, columns: str) -> str:
    """Emissions per cell, from the key table of the distinct codes."""
    clause, key = key_sql(code, s)
    same = " AND ".join(f"l.{c} = r.{c}" for c in key)
    on = NEIGHBOURS.format(a="l", z="r")
    cols = ", ".join([*key, "x"])
    return (
        f"{clause}, d AS (SELECT DISTINCT {cols} FROM k) "
        f"SELECT {columns} FROM d l JOIN d r ON {same} AND {on}"
    )


# -- the strategies under their test parameters -------------------------------

def parameters(name: str, b: int) -> dict:
    """A parameter that is valid at any even ``b``; blocks by value so that SQL can follow."""
    half = b // 2
    return {
        "hashing": {"J": 4, "block_by": "mod"},
        "group": {"u": next(u for u in (2, 1) if half % u == 0)},
        "multisection": {"section": min(4, b)},
    }.get(name, {})


def strategies(b: int) -> list[Strategy]:
    names = ("serial", "hashing", "group", "maxparallel", "multisection")
    return [strategy(name, b, **parameters(name, b)) for name in names]


# -- pairs --------------------------------------------------------------------

def _pairs(code: str, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df, b = coded(code, spark, sf_dir)
    params = parameters(name, b)
    params.pop("block_by", None)
    return pairs(df, b, name, clustered=code == "orders", **params)  # running numbers


for _code in ("emb8", "months", "orders", "shipping"):
    for _name in ("serial", "hashing", "group", "maxparallel", "multisection"):
        register(f"pairs_{_name}_{_code}", partial(_pairs, _code, _name), pair_sql(_code))
for _code in ("emb8", "emb16", "emb72", "months", "orders", "digest", "shipping"):
    register(f"pairs_auto_{_code}", partial(_pairs, _code, "auto"), pair_sql(_code))
for _code in ("emb16", "digest"):
    register(f"pairs_multisection_{_code}", partial(_pairs, _code, "multisection"), pair_sql(_code))


def _raw(code: str, s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(CODES[code](spark, sf_dir), s.b, s, mode="raw", with_key=True)
    return flat(df, "x_lo", "x_hi")


# -- the strategies on their own cells -------------------------------------------

def _cell_pairs(code: str, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df, b = coded(code, spark, sf_dir)
    params = parameters(name, b)
    params.pop("block_by", None)
    s = strategy(name, b, **params)
    return pairs(df, b, s, execution="cells", unique=code == "orders", partitions=cell_partitions(code, s, cell_rows_of(s), spark, sf_dir))


for _code in ("months", "orders", "shipping"):
    for _name in ("serial", "hashing", "group", "maxparallel", "multisection"):
        register(f"pairs_cells_{_name}_{_code}", partial(_cell_pairs, _code, _name), pair_sql(_code))


def _cell_raw(code: str, s: Strategy, cell_rows: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(CODES[code](spark, sf_dir), s.b, s, mode="raw", with_key=True, execution="cells", cell_rows=cell_rows)
    return flat(df, "x_lo", "x_hi")


_RAW = [strategy("hashing", 12, J=J, block_by="mod") for J in (2, 3, 4)] + [strategy("group", 12, u=u) for u in (1, 2, 3)]
_RAW += [strategy("maxparallel", 12), strategy("multisection", 12, section=2), strategy("multisection", 12, section=5)]
for _s in _RAW:
    _clause, _key = key_sql("months", _s)
    _cols = ", ".join(f"l.{c} AS {c}" for c in _key) + ", l.x AS x_lo, r.x AS x_hi"
    # 50: blocks of the small tables are cut as well
    register(f"pairs_cells_raw_{_s.name}{_s.param or ''}_months", partial(_cell_raw, "months", _s, 50), raw_sql("months", _s, _cols))


def _timing(code: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the phases of one run of each strategy hand on; their times vary and are left out."""
    found = timing_profile(CODES[code](spark, sf_dir), strategies(WIDTH[code]), reps=1)
    return found.select("strategy", F.col("param").cast("bigint").alias("param"), "phase", F.col("rep").cast("bigint").alias("rep"), "rows")


def _timing_sql(code: str, s: Strategy) -> str:
    clause, key = key_sql(code, s)
    by, same = ", ".join(key), " AND ".join(f"l.{c} = r.{c}" for c in key)
    half = s.b // 2

    def masks(ranges: list[tuple[int, int]]) -> str:
        return "(VALUES " + ", ".join(f"({x.section}, {x.position}, {x.mask}::BIGINT)" for x in s.layout.slices(ranges)) + ") v(part, t, mask)"

    grouped = {
        "maxparallel": f"SELECT DISTINCT {by} FROM d",
        "multisection": "SELECT * FROM d",
        "group": f"""SELECT DISTINCT gi, gj, part, w - up, t, x & ~mask
            FROM (SELECT *, CASE part WHEN 0 THEN bit_count(x >> {half}) ELSE bit_count(x & {(1 << half) - 1}) END AS w
                  FROM d, {masks([(half, s.b), (0, half)])}), (VALUES (0), (1)) u(up)""",
    }.get(s.name, f"SELECT DISTINCT {by}, t, x & ~mask FROM d, {masks([(0, s.b)])}")
    return f"""{clause}, d AS (SELECT DISTINCT {by}, x FROM k),
        p AS (SELECT 'map' AS phase, (SELECT count(*) FROM d) AS rows
              UNION ALL SELECT 'group', (SELECT count(*) FROM ({grouped}))
              UNION ALL SELECT unnest(['reduce', 'overall']), (SELECT count(*) FROM d l JOIN d r ON {same} AND {NEIGHBOURS.format(a='l', z='r')}))
        SELECT '{s.name}' AS strategy, {s.param}::BIGINT AS param, phase, 0::BIGINT AS rep, rows FROM p"""


register("timing_profile_months", partial(_timing, "months"),
         " UNION ALL ".join(f"SELECT * FROM ({_timing_sql('months', s)})" for s in strategies(12)))


def _timing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs each of two strategies, appended to a report of times, read back and summed up."""
    path = scratch(spark, "times")
    for s in _TIMED:
        append_report(timing_profile(months(spark, sf_dir), [s], reps=2), path, run_id=s.name)
    found = timing_summary(read_report(spark, path, TIMING_SCHEMA))
    ordered = (F.col("ms_min") <= F.col("ms_avg")) & (F.col("ms_avg") <= F.col("ms_max"))
    return found.select("strategy", F.col("param").cast("bigint").alias("param"), "phase", "reps", ordered.alias("ordered"))


_TIMED = [strategy("hashing", 12, J=2, block_by="mod"), strategy("multisection", 12, section=2)]
register("timing_report_months", _timing_report,
         "SELECT strategy, 2::BIGINT AS param, phase, 2::BIGINT AS reps, true AS ordered FROM "
         "(SELECT unnest(['hashing', 'multisection']) AS strategy), (SELECT unnest(['map', 'group', 'reduce', 'overall']) AS phase)")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys dealt by ``repartition``: whether each stands in the partition that ``placement`` names."""
    s = strategy("hashing", 32, J=8, block_by="placement")
    dealt = order_keys(spark, sf_dir).repartition(s.param, "x")
    return dealt.groupBy((F.spark_partition_id() == block_of([F.col("x")], s)).alias("placed")).agg(F.count("*").alias("n"))


register("placement_orders", _placed, "SELECT true AS placed, count(*) AS n FROM orders")


# -- keys, groups, histograms and costs per strategy ---------------------------

def _keys(code: str, s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(keyed(CODES[code](spark, sf_dir), s), "id", "x")


def _group_sizes(code: str, s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(group_sizes(CODES[code](spark, sf_dir), s), "q")


def _size_histogram(code: str, s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_histogram(CODES[code](spark, sf_dir), s)


def _emits_histogram(code: str, s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    return emits_histogram(CODES[code](spark, sf_dir), s)


def _cost(code: str, s: Strategy, spark: SparkSession, sf_dir: str, **volumes: int) -> DataFrame:
    return _as_big(cost_profile(CODES[code](spark, sf_dir), s, **volumes))


def _as_big(df: DataFrame) -> DataFrame:
    """Counts as BIGINT; the exact decimal, which BIGINT may not hold, as text."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("param", "b", "k")}
                          | {"red_out_kb": F.col("red_out_kb").cast("string")})


def _cost_sql(code: str, s: Strategy, k: int = 1, key_volume: int = 0) -> str:
    clause, key = key_sql(code, s)
    return _profile_sql(clause, key, f"'{s.name}'", f"{s.param}::BIGINT", f"{s.b}::BIGINT", k, key_volume)


def _profile_sql(clause: str, key: list[str], name: str, param: str, b: str, k: int = 1, key_volume: int = 0,
                 near: str = NEIGHBOURS.format(a="l", z="r")) -> str:
    same = " AND ".join(f"l.{c} = r.{c}" for c in key)
    by = ", ".join(key)
    return f"""{clause},
        q AS (SELECT {by}, count(*) AS q FROM k GROUP BY {by}),
        e AS (SELECT count(*) AS emitted FROM k l JOIN k r ON {same} AND {near})
        SELECT {name} AS strategy, {param} AS param, {b} AS b, {k}::BIGINT AS k,
               (SELECT count(*) FROM c) AS map_in, (SELECT count(*) FROM k) AS map_out,
               (SELECT {k} * count(*) FROM c) AS map_in_kb, (SELECT {k + key_volume} * count(*) FROM k) AS map_out_kb,
               (SELECT ({k + key_volume} * sum(q))::BIGINT FROM q) AS red_in_kb,
               (SELECT ({2 * k + key_volume} * emitted)::DECIMAL(38,0)::VARCHAR FROM e) AS red_out_kb,
               (SELECT max(q) FROM q) AS q_max, (SELECT sum(q)::BIGINT FROM q) AS q_sum,
               (SELECT count(*) FROM q) AS reducers"""


for _code in ("emb8", "months"):
    for _s in strategies(WIDTH[_code]):
        _clause, _key = key_sql(_code, _s)
        _by = ", ".join(_key)
        _suffix = f"{_s.name}_{_code}"
        register(f"keys_{_suffix}", partial(_keys, _code, _s), f"{_clause} SELECT {_by}, id, x FROM k")
        register(
            f"group_sizes_{_suffix}",
            partial(_group_sizes, _code, _s),
            f"{_clause} SELECT {_by}, count(*) AS q FROM k GROUP BY {_by}",
        )
        register(
            f"size_histogram_{_suffix}",
            partial(_size_histogram, _code, _s),
            f"{_clause} SELECT q, count(*) AS n FROM (SELECT count(*) AS q FROM k GROUP BY {_by}) "
            "GROUP BY q",
        )
        register(
            f"emits_histogram_{_suffix}",
            partial(_emits_histogram, _code, _s),
            f"{_clause} SELECT r, count(*) AS n FROM (SELECT count(*) AS r FROM k GROUP BY id) "
            "GROUP BY r",
        )
        register(f"cost_{_suffix}", partial(_cost, _code, _s), _cost_sql(_code, _s))
        if not _s.exactly_once:
            _cols = ", ".join(f"l.{c} AS {c}" for c in _key) + ", l.x AS x_lo, r.x AS x_hi"
            register(f"pairs_raw_{_suffix}", partial(_raw, _code, _s), raw_sql(_code, _s, _cols))


# other parameters than the usual ones, and volumes of keys and records
_MORE = [strategy("hashing", 12, J=2, block_by="mod"), strategy("hashing", 12, J=3, block_by="mod"),
         strategy("group", 12, u=1), strategy("group", 12, u=3), strategy("multisection", 12, section=5)]
for _s in _MORE:
    _clause, _key = key_sql("months", _s)
    _suffix = f"{_s.name}{_s.param}_months"
    register(f"keys_{_suffix}", partial(_keys, "months", _s), f"{_clause} SELECT {', '.join(_key)}, id, x FROM k")
    register(f"cost_{_suffix}", partial(_cost, "months", _s, k=3, key_volume=2), _cost_sql("months", _s, 3, 2))
    _cols = ", ".join(f"l.{c} AS {c}" for c in _key) + ", l.x AS x_lo, r.x AS x_hi"
    register(f"pairs_raw_{_suffix}", partial(_raw, "months", _s), raw_sql("months", _s, _cols))


# -- codes of more than 63 bits: text, and a width that follows from the table ------------

WIDE = {"serial": {}, "group": {"u": 1}, "maxparallel": {}, "multisection": {"section": 4}}


def wide_key_sql(name: str) -> tuple[str, list[str]]:
    """``key_sql`` for shipping months."""
    start = f"WITH w AS {_SHIP_WINDOW}, c AS (SELECT id, x, b FROM ({CODE_SQL['shipping']}), w),"
    weight = "length(replace({0}, '0', ''))::BIGINT"
    if name == "serial":
        return f"{start} k AS (SELECT 1::BIGINT AS one, id, x FROM c)", ["one"]
    if name == "group":
        left, right = weight.format("substr(x, 1, b // 2)"), weight.format("substr(x, b // 2 + 1)")
        cell = "CASE WHEN {0} = b // 2 THEN {0} ELSE {0} + 1 END"
        return f"""{start} v AS (SELECT id, x, b, {left} AS wl, {right} AS wr FROM c),
            h AS (SELECT id, x, wl, wr, {cell.format('wl')} AS i, {cell.format('wr')} AS j FROM v),
            k AS (SELECT i AS gi, j AS gj, id, x FROM h
                  UNION ALL SELECT i - 1, j, id, x FROM h WHERE i > 1 AND wl = i - 1
                  UNION ALL SELECT i, j - 1, id, x FROM h WHERE j > 1 AND wr = j - 1)""", ["gi", "gj"]
    if name == "maxparallel":
        return f"""{start} k AS (SELECT p, substr(x, 1, b - p - 1) || '0' || substr(x, b - p + 1) AS masked, id, x
            FROM (SELECT *, unnest(range(b)) AS p FROM c))""", ["p", "masked"]
    return f"""{start} k AS (SELECT m, substr(x, 1, b * m // 4) || repeat('0', b * (m + 1) // 4 - b * m // 4)
            || substr(x, b * (m + 1) // 4 + 1) AS rest, id, x
            FROM (SELECT *, unnest(range(4::BIGINT)) AS m FROM c))""", ["m", "rest"]


def _wide(make: Callable[[DataFrame, Strategy, int], DataFrame], name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df, b = shipping_coded(spark, sf_dir)
    s = strategy(name, b, **WIDE[name])
    return make(df, s, cell_partitions("shipping", s, len(s.free_ranges), spark, sf_dir))


for _name in WIDE:
    _clause, _key = wide_key_sql(_name)
    _by = ", ".join(_key)
    register(f"keys_{_name}_shipping", partial(_wide, lambda df, s, _: flat(keyed(df, s), "id", "x"), _name),
             f"{_clause} SELECT {_by}, id, x FROM k")
    register(f"group_sizes_{_name}_shipping", partial(_wide, lambda df, s, n: flat(group_sizes(df, s, partitions=n), "q"), _name),
             f"{_clause} SELECT {_by}, count(*) AS q FROM k GROUP BY {_by}")
    _near = "l.x < r.x AND hamming(l.x, r.x) = 1"
    register(f"cost_{_name}_shipping", partial(_wide, lambda df, s, n: _as_big(cost_profile(df, s, partitions=n)), _name),
             _profile_sql(_clause, _key, f"'{_name}'", f"{next(iter(WIDE[_name].values()), 0)}::BIGINT", "(SELECT b FROM w)", near=_near))
    _same = " AND ".join(f"l.{c} = r.{c}" for c in _key)
    # cells of two codes where that is the definition, else all codes of a cell compared
    register(f"pairs_raw_{_name}_shipping",
             partial(_wide, lambda df, s, _: flat(pairs(df, s.b, s, mode="raw", with_key=True), "x_lo", "x_hi"), _name),
             f"{_clause} SELECT {_by}, min(x) AS x_lo, max(x) AS x_hi FROM k GROUP BY {_by} HAVING count(DISTINCT x) = 2" if _name == "maxparallel" else
             f"{_clause}, d AS (SELECT DISTINCT {_by}, x FROM k) SELECT {', '.join(f'l.{c} AS {c}' for c in _key)}, "
             f"l.x AS x_lo, r.x AS x_hi FROM d l JOIN d r ON {_same} AND {_near}")
register("groups_multisection_shipping", partial(_wide, lambda df, s, n: flat(
    groups(df.withColumn("x", F.concat("x", F.lit("-"), "id")), strategy("multisection", s.b, section=s.b // 2),
           partitions=n * (s.b // 2) // len(s.free_ranges))
    .withColumn("members", F.concat_ws(",", "members")), "members"), "multisection"),
    f"WITH w AS {_SHIP_WINDOW}, d AS (SELECT DISTINCT x, b FROM ({CODE_SQL['shipping']}), w), "
    "k AS (SELECT m, substr(x, 1, 2 * m) || '00' || substr(x, 2 * m + 3) AS rest, x FROM (SELECT *, unnest(range(b // 2)) AS m FROM d)) "
    "SELECT m, rest, string_agg(x, ',' ORDER BY x) AS members FROM k GROUP BY m, rest")


def _cost_orders(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the unique order keys; the width follows from the table."""
    df = CODES["orders"](spark, sf_dir)
    b = even_width(df)
    s = strategy(name, b, **({"section": b // 2} if name == "multisection" else {}))
    return _as_big(cost_profile(df, s, unique=True)).drop("param")


def _cost_orders_sql(name: str) -> str:
    """The width is taken from the data, so the sections are computed in SQL as well."""
    b = "(SELECT (length(bin(max(o_orderkey))) + 1) // 2 * 2 FROM orders)"
    span = {"maxparallel": 1, "multisection": 2}[name]
    return f"""
        WITH c AS (SELECT o_orderkey AS x, {b} AS b FROM orders),
        k AS (SELECT m, x & ~({(1 << span) - 1}::BIGINT << (m * {span})::INT) AS rest, x
              FROM (SELECT x, unnest(range(b // {span})) AS m FROM c)),
        q AS (SELECT m, rest, count(*) AS q FROM k GROUP BY m, rest),
        e AS (SELECT count(*) AS emitted FROM k l JOIN k r
              ON l.m = r.m AND l.rest = r.rest AND {NEIGHBOURS.format(a='l', z='r')})
        SELECT '{name}' AS strategy, {b}::BIGINT AS b, 1::BIGINT AS k,
               (SELECT count(*) FROM c) AS map_in, (SELECT count(*) FROM k) AS map_out,
               (SELECT count(*) FROM c) AS map_in_kb, (SELECT count(*) FROM k) AS map_out_kb,
               (SELECT sum(q)::BIGINT FROM q) AS red_in_kb,
               (SELECT (2 * emitted)::DECIMAL(38,0)::VARCHAR FROM e) AS red_out_kb,
               (SELECT max(q) FROM q) AS q_max, (SELECT sum(q)::BIGINT FROM q) AS q_sum,
               (SELECT count(*) FROM q) AS reducers"""


for _name in ("maxparallel", "multisection"):
    register(f"cost_{_name}_orders", partial(_cost_orders, _name), _cost_orders_sql(_name))


# -- groups as lists -----------------------------------------------------------

def _groups(code: str, s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = groups(CODES[code](spark, sf_dir), s)
    listed = df.withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))
    return flat(listed, "members")


for _code in ("emb8", "months"):
    for _s in strategies(WIDTH[_code]):
        if _s.cell_bound:
            _clause, _key = key_sql(_code, _s)
            _by = ", ".join(_key)
            register(
                f"groups_{_s.name}_{_code}",
                partial(_groups, _code, _s),
                f"{_clause} SELECT {_by}, string_agg(x::VARCHAR, ',' ORDER BY x) AS members "
                f"FROM (SELECT DISTINCT {_by}, x FROM k) GROUP BY {_by}",
            )


# -- records ---------------------------------------------------------------------

def _record_pair_counts(code: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_pair_counts(CODES[code](spark, sf_dir), WIDTH[code])


def _record_pairs(hot_rows: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = turns(spark, sf_dir)
    return record_pairs(df, bit_width(df, "x"), "multisection", section=2, hot_rows=hot_rows)


def _record_pairs_payload(hot_rows: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = turns(spark, sf_dir)
    return record_pairs(df, bit_width(df, "x"), "maxparallel", payload=["role"], hot_rows=hot_rows)


def _code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_counts(months(spark, sf_dir), 12)


for _code in ("emb8", "months", "digest"):
    register(
        f"record_pair_counts_{_code}",
        partial(_record_pair_counts, _code),
        f"WITH c AS ({CODE_SQL[_code]}), d AS (SELECT x, count(*) AS n FROM c GROUP BY x) "
        "SELECT l.x AS x_lo, r.x AS x_hi, l.n AS n_lo, r.n AS n_hi FROM d l JOIN d r ON "
        + NEIGHBOURS.format(a="l", z="r"),
    )
_RECORD_SQL = (
    f"WITH c AS ({CODE_SQL['turns']}) SELECT l.id AS id_a, r.id AS id_b, l.x AS x_a, r.x AS x_b"
    "{more} FROM c l JOIN c r ON " + NEIGHBOURS.format(a="l", z="r")
)
for _suffix, _rows in (("", HOT_ROWS), ("_split", 2)):  # most conversations have more than two turns
    register(f"record_pairs_turns{_suffix}", partial(_record_pairs, _rows), _RECORD_SQL.format(more=""))
    register(
        f"record_pairs_payload_turns{_suffix}",
        partial(_record_pairs_payload, _rows),
        _RECORD_SQL.format(more=", l.role AS role_a, r.role AS role_b"),
    )
register(
    "code_counts_months",
    _code_counts,
    f"WITH c AS ({CODE_SQL['months']}) SELECT x, count(*) AS n FROM c GROUP BY x",
)


# -- sources, scalar functions and text ---------------------------------------------

def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of every possible month code: 2^12 codes, whatever the tables hold."""
    used = months(spark, sf_dir).select("x", F.col("id").alias("customer"))
    return bit_universe(spark, 12).join(used, "x", "left").select("bits", F.coalesce("customer", F.lit(-1)).alias("customer"))


register(
    "bit_universe",
    _universe,
    f"WITH c AS ({CODE_SQL['months']}), u AS (SELECT unnest(range(4096::BIGINT)) AS u) "
    "SELECT lpad(bin(u), 12, '0') AS bits, coalesce(id, -1) AS customer FROM u LEFT JOIN c ON x = u",
)


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month codes as text of one kilobyte each."""
    df = months(spark, sf_dir).withColumn("bits", fb.long_to_bits("x", 12))
    df = with_payload(df, 12, payload_length(1))
    return df.select("id", "bitstring", fb.byte_length("bitstring").alias("bytes"))


register(
    "bitstring_payload",
    _payload,
    f"WITH c AS ({CODE_SQL['months']}) SELECT id, rpad(lpad(bin(x), 12, '0'), 951, '0') AS bitstring, "
    "951::BIGINT AS bytes FROM c",
)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys written as bitstrings and read back."""
    df = order_keys(spark, sf_dir)
    b = bit_width(df, "x")
    path = scratch(spark, "bitstrings")
    write_bitstrings(df.withColumn("bits", fb.long_to_bits("x", b)), path)
    return read_bitstrings(spark, path, b)


register(
    "csv_roundtrip",
    _csv,
    "SELECT o_orderkey AS id, lpad(bin(o_orderkey), "
    "(SELECT length(bin(max(o_orderkey)))::INT FROM orders), '0') AS bits, o_orderkey AS x FROM orders",
)


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as bitstrings in lines of which some are broken: what is read and what is not."""
    df = order_keys(spark, sf_dir)
    b = bit_width(df, "x")
    path = scratch(spark, "lines")
    key, bits = F.col("x").cast("string"), fb.long_to_bits("x", b)
    line = (F.when(F.col("x") % 7 == 1, F.concat(key, F.lit(";"), bits)).when(F.col("x") % 7 == 2, F.concat(key, F.lit("x,"), bits))
            .when(F.col("x") % 7 == 3, F.concat(key, F.lit(",2"), bits)).otherwise(F.concat(key, F.lit(","), bits)))
    df.select(line.alias("value")).write.text(path)
    codes, rejects = scan_bitstrings(spark, path, b)
    read = codes.select(F.concat_ws(",", "id", "bits").alias("line"), F.lit("none").alias("reason"), "x")
    return read.unionByName(rejects.select("line", "reason", F.lit(-1).cast("bigint").alias("x")))


register(
    "csv_rejects",
    _rejects,
    "WITH c AS (SELECT o_orderkey AS x, lpad(bin(o_orderkey), (SELECT length(bin(max(o_orderkey)))::INT FROM orders), '0') AS bits FROM orders) "
    "SELECT x || CASE x % 7 WHEN 1 THEN ';' WHEN 2 THEN 'x,' WHEN 3 THEN ',2' ELSE ',' END || bits AS line, "
    "CASE x % 7 WHEN 1 THEN 'fields' WHEN 2 THEN 'key' WHEN 3 THEN 'bits' ELSE 'none' END AS reason, "
    "CASE WHEN x % 7 IN (1, 2, 3) THEN -1 ELSE x END AS x FROM c",
)


def _layout(code: str, section: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a code table that is kept in buckets of its cells."""
    df, b = coded(code, spark, sf_dir)
    s = strategy("multisection", b, section=section)
    path = scratch(spark, "codes")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    write_codes(df, s, name, path, 8)
    return stored_pairs(spark, s, name)


for _code in ("months", "shipping"):
    register(f"pairs_layout_{_code}", partial(_layout, _code, 4), pair_sql(_code))


def _key_volume(s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_volume(months(spark, sf_dir), s)


for _s in strategies(WIDTH["months"]):
    _clause, _key = key_sql("months", _s)
    register(f"key_volume_{_s.name}_months", partial(_key_volume, _s),
             f"{_clause} SELECT count(*) AS keys, sum(strlen(concat_ws(',', {', '.join(_key)})))::BIGINT AS bytes, "
             f"max(strlen(concat_ws(',', {', '.join(_key)}))) AS longest FROM k")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost rows of two strategies, appended one after the other, each of them twice, and read back."""
    df = months(spark, sf_dir)
    path = scratch(spark, "report")
    for s in _REPORTED:
        report = cost_profile(df, s)
        for _ in range(2):  # a run that is repeated leaves its rows once
            append_report(report, path, run_id=s.name)
    return _as_big(read_report(spark, path, report.schema))


_REPORTED = [strategy("maxparallel", 12), strategy("multisection", 12, section=3)]
register(
    "report_append",
    _report,
    " UNION ALL ".join(f"SELECT * FROM ({_cost_sql('months', s)})" for s in _REPORTED),
)


def _functions_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = 12
    df = months(spark, sf_dir).withColumn("bits", fb.long_to_bits("x", b))
    left, right = fb.half_weights("x", b)
    flipped = fb.flip_bit("x", 0)
    return df.select(
        "id",
        "bits",
        fb.bits_to_long("bits", b).alias("parsed"),
        fb.bit_prefix("bits", 6).alias("prefix"),
        left.cast("bigint").alias("ones_left"),
        right.cast("bigint").alias("ones_right"),
        fb.text_ones("bits").cast("bigint").alias("ones"),
        fb.section_value("x", b, 3, 1).alias("middle"),
        fb.drop_section("x", b, 3, 1).alias("outside"),
        fb.section_text("bits", b, 3, 1).alias("middle_text"),
        fb.drop_section_text("bits", b, 3, 1).alias("outside_text"),
        flipped.alias("flipped"),
        fb.clear_bit("x", 3).alias("cleared"),
        fb.hamming("x", F.lit((1 << b) - 1)).cast("bigint").alias("missing"),
        fb.is_neighbour("x", flipped).alias("near"),
        fb.is_section_neighbour("x", flipped, b, 3, 2).alias("near_in_last"),
        fb.is_section_neighbour("x", flipped, b, 3, 0).alias("near_in_first"),
        fb.unordered("x", flipped)["lo"].alias("lower"),
        fb.text_hamming("bits", fb.long_to_bits(flipped, b), b).cast("bigint").alias("text_distance"),
        fb.byte_length(fb.pad_bits("bits", 20)).alias("bytes"),
    )


register(
    "bit_functions_months",
    _functions_months,
    f"""WITH c AS (SELECT id, x, lpad(bin(x), 12, '0') AS bits FROM ({CODE_SQL['months']}))
    SELECT id, bits, x AS parsed, substr(bits, 1, 6) AS prefix,
           bit_count(x >> 6)::BIGINT AS ones_left, bit_count(x & 63)::BIGINT AS ones_right,
           length(replace(bits, '0', ''))::BIGINT AS ones, (x >> 4) & 15 AS middle,
           x & ~240 AS outside, substr(bits, 5, 4) AS middle_text,
           substr(bits, 1, 4) || substr(bits, 9, 4) AS outside_text,
           xor(x, 1) AS flipped, x & ~8 AS cleared, 12 - bit_count(x)::BIGINT AS missing,
           true AS near, true AS near_in_last, false AS near_in_first,
           least(x, xor(x, 1)) AS lower, 1::BIGINT AS text_distance, 20::BIGINT AS bytes
    FROM c""",
)


def _codes(code: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return CODES[code](spark, sf_dir).select("id", "x")


for _code in ("emb8", "emb64", "emb72", "months", "shipping", "digest"):
    register(f"codes_{_code}", partial(_codes, _code), CODE_SQL[_code])


def _formatted(style: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs(months(spark, sf_dir), 12)
    options = {"section": 3} if style == "sections" else {"payload": 20}
    return format_pairs(found, 12, style, **options).select("result")


def _shown(x: str, style: str) -> str:
    bits = f"lpad(bin({x}), 12, '0')"
    if style == "sections":
        return "".join(f" || ' ' || substr({bits}, {i}, 4)" for i in (1, 5, 9))
    return f" || rpad({bits}, 20, '0')"


for _style in ("plain", "reversed", "sections"):
    _a, _z = ("r.x", "l.x") if _style == "reversed" else ("l.x", "r.x")
    register(
        f"pairs_formatted_{_style}",
        partial(_formatted, _style),
        pair_sql("months", f"'['{_shown(_a, _style)} || ','{_shown(_z, _style)} || ']' AS result"),
    )


def _formatted_keys(s: Strategy, spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_keys(keyed(months(spark, sf_dir), s)).select("key", "id")


for _s in strategies(WIDTH["months"]):
    _clause, _key = key_sql("months", _s)
    register(
        f"keys_formatted_{_s.name}",
        partial(_formatted_keys, _s),
        f"{_clause} SELECT concat_ws(',', {', '.join(_key)}) AS key, id FROM k",
    )
