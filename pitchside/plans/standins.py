"""Adapters from the driver's TPC-H-ish tables onto the soccer schemas.

The test tables carry no soccer data, so each adapter derives a frame in the
domain schema from them (SURVEY 7.3 role mapping): supplier = player,
return flag = team, quantity = minutes, part name words = positions, ship date
= season, part type = team of a team-match row, orders = match reports, and so
on. Every derived column is one SQL expression that Spark and DuckDB evaluate
identically, so the same text feeds ``F.expr`` here and the oracle SQL.
The adapters only project and join; all work grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside import presets
from pitchside.functions.sql import project

# --- stand-in configuration (not reference values) --------------------------
# part-name word -> canonical position; "small" is left unmapped on purpose.
STANDIN_POSITION_MAP = {
    "anvil": "GK", "blue": "CB", "bolt": "CB", "cold": "CB", "gear": "LB",
    "gizmo": "RB", "hot": "DMF", "large": "AMF", "new": "CF", "old": "LW",
    "plate": "RW", "red": "LCM", "ring": "RCM", "rod": "AMF", "widget": "RW",
}
STANDIN_SEASON = 1998
STANDIN_OWN_TEAM = "N"
#: Line items that a task of the formation or lane tokens takes; its sorts hold some 1 KB for each of them.
TASK_ROWS = 250_000

PLAYER_MATCH_EXPRS = [
    ("year", "year(l_shipdate)"),
    ("player_name", "concat('S', cast(l_suppkey AS string))"),
    ("team", "l_returnflag"),
    ("Position", "replace(p_name, ' ', ', ')"),
    ("Minutes played", "l_quantity"),
    ("aerial_duels_won", "cast(l_linenumber AS double)"),
    ("interceptions", "l_tax * 100"),
    ("recoveries", "l_discount * 100"),
    ("defensive_duels_won", "cast(l_linenumber % 3 AS double)"),
    ("clearances", "l_extendedprice / 10000"),
    ("goals", "cast(l_linenumber % 2 AS double)"),
    ("assists", "cast(l_partkey % 3 AS double)"),
    ("xg", "l_discount * 10"),
    ("successful_dribbles", "cast(l_suppkey % 4 AS double)"),
    ("xa", "l_tax * 10"),
    ("passes_into_final_third", "cast(l_orderkey % 7 AS double)"),
    ("passes_into_box", "cast(l_partkey % 5 AS double)"),
    ("forward_passes", "l_extendedprice / 1000"),
    ("crosses", "cast(l_linenumber % 4 AS double)"),
]

TEAM_MATCH_EXPRS = [
    ("date", "l_shipdate"),
    ("team", "CASE WHEN l_linenumber = 1 THEN ' ' || substring(o_orderpriority, 3) || ' ' "
             "ELSE substring(o_orderpriority, 3) END"),
    ("goals", "l_linenumber % 3"),
    ("xg", "l_discount * 10"),
    ("shots", "l_linenumber"),
    ("sot", "l_linenumber % 4"),
    ("pass_success_rate", "l_tax * 1000"),
    ("possession", "l_quantity * 2"),
    ("losses", "cast(l_quantity AS int) % 9"),
    ("recoveries", "cast(l_quantity AS int) % 11"),
    ("tot_duels", "cast(l_quantity AS int)"),
    ("tot_duels_won", "cast(l_quantity AS int) % 13"),
    ("tot_duels_win_rate", "l_discount * 500"),
    ("corners", "l_linenumber % 5"),
    ("fouls", "l_linenumber % 6"),
    ("yellows", "l_linenumber % 2"),
    ("reds", "CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END"),
    ("shots_against", "(l_linenumber + 3) % 7"),
    ("goals_against", "(l_linenumber + 1) % 3"),
    ("def_duels", "cast(l_quantity AS int) % 17"),
    ("interceptions", "cast(l_quantity AS int) % 7"),
    ("clearences", "cast(l_quantity AS int) % 5"),
    ("offsides", "l_linenumber % 2"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, exprs) -> DataFrame:
    return project(df, exprs)


def player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part -> player-match rows (one per line item)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return _project(li.join(part, li.l_partkey == part.p_partkey, "left"), PLAYER_MATCH_EXPRS)


def _order_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts of ``TASK_ROWS`` line items; 0 if that gives no more than Spark makes by itself."""
    parts = -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS)
    return parts if parts > spark.sparkContext.defaultParallelism else 0


def _lineitem_orders(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """``by_order``: both tables dealt by order for the join, in as many parts as there are ``TASK_ROWS`` line items, so
    what follows by order (several sorts in the same task) takes tasks of one size, however large the tables are."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    if by_order and (parts := _order_parts(spark, sf_dir)):
        # dealt already, so nothing is gained by sending all orders to every task
        li, orders = li.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey").hint("merge")
    return li.join(orders, li.l_orderkey == orders.o_orderkey, "left")


def team_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders -> team-match rows (team = order priority name)."""
    return _project(_lineitem_orders(spark, sf_dir), TEAM_MATCH_EXPRS)


def lane_tokens(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """lineitem x orders -> shooting-side OCR tokens (image = order)."""
    return _project(_lineitem_orders(spark, sf_dir, by_order), LANE_TOKEN_EXPRS)


def report_images(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """orders -> the list of report images (kept even without tokens)."""
    orders = table(spark, sf_dir, "orders")
    if by_order and (parts := _order_parts(spark, sf_dir)):
        orders = orders.select("o_orderkey", "o_orderpriority").repartition(parts, "o_orderkey").hint("merge")
    return _project(orders, IMAGE_EXPRS)


def formation_table_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = "named_struct(" + ", ".join(f"'{k}', {k}" for k in ORDER_KEYS) + ")"
    return _project(_lineitem_orders(spark, sf_dir, by_order=True), FORMATION_TABLE_EXPRS + [("seq", seq)])


def formation_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black and blue tokens of each line item, from one join. The image stays a column of its own, so that Spark knows the
    tokens as dealt by it."""
    image, key = FORMATION_BLACK_EXPRS[0]
    both = ", ".join("named_struct(" + ", ".join(f"'{n}', {e}" for n, e in exprs[1:]) + ")" for exprs in (FORMATION_BLACK_EXPRS, FORMATION_BLUE_EXPRS))
    return _lineitem_orders(spark, sf_dir, by_order=True).selectExpr(f"{key} AS {image}", f"inline(array({both}))")


ORDER_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_KEYS = [(k, k) for k in ORDER_KEYS]
_TEAM = "substring(o_orderpriority, 3)"

LANE_TOKEN_EXPRS = [
    ("image_id", "l_orderkey"),
    ("team", _TEAM),
    ("x", "cast(l_partkey % 50 AS double)"),
    *_KEYS,
    ("text", "CASE "
             "WHEN l_tax <= CAST(0.025 AS DOUBLE) THEN cast(cast(l_quantity AS int) AS string) || ' / ' "
             "|| cast(cast(floor(l_discount * 100) AS int) AS string) || '.' "
             "|| cast(l_linenumber AS string) || ' XG' "
             "WHEN l_tax <= CAST(0.035 AS DOUBLE) THEN cast(l_linenumber AS string) || '/<0.0' "
             "|| cast(l_partkey % 10 AS string) || 'XG' "
             "WHEN l_tax <= CAST(0.045 AS DOUBLE) THEN 'x / 0.' || cast(l_linenumber AS string) || ' XG' "
             "WHEN l_tax <= CAST(0.065 AS DOUBLE) THEN cast(cast(l_quantity AS int) AS string) || '%' "
             "WHEN l_tax <= CAST(0.075 AS DOUBLE) THEN cast(l_linenumber AS string) || ' / XG' "
             "ELSE 'a' || cast(l_linenumber AS string) || '%' END"),
]

IMAGE_EXPRS = [("image_id", "o_orderkey"), ("team", "substring(o_orderpriority, 3)")]

FORMATION_TABLE_EXPRS = [
    ("image_id", "l_orderkey"),
    ("team", _TEAM),
    *_KEYS,
    ("text", "CASE "
             f"WHEN l_linenumber IN (1, 7) THEN 'Team ' || {_TEAM} "
             "WHEN l_linenumber = 4 THEN 'Rival ' || o_orderstatus "
             "WHEN l_linenumber = 6 AND l_tax > CAST(0.045 AS DOUBLE) "
             "THEN cast(cast(l_quantity AS int) AS string) || '.5m' "
             "ELSE cast(cast(l_quantity AS int) AS string) || '.' || cast(l_partkey % 10 AS string) END"),
]
FORMATION_BLACK_EXPRS = [
    ("image_id", "l_orderkey"), ("section", "'black'"), ("x", "l_extendedprice"), ("seq", "l_partkey"),
    ("text", "cast(cast(l_quantity AS int) AS string)"),
]
FORMATION_BLUE_EXPRS = [
    ("image_id", "l_orderkey"), ("section", "'blue'"), ("x", "cast(l_suppkey AS double)"),
    ("seq", "l_partkey"),
    ("text", "CASE WHEN l_tax > CAST(0.075 AS DOUBLE) THEN 'n' || cast(l_partkey % 97 AS string) "
             "ELSE cast(l_partkey % 97 AS string) END"),
]


# line items as accepted formation rows (nine values each); every fifth part gives an empty one
FORMATION_VALUE_EXPRS = [("image_id", "l_orderkey"), ("image_team", "l_returnflag")] + [
    (c, f"CASE WHEN l_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity + CAST({i}.75 AS DOUBLE) - CAST(l_linenumber AS DOUBLE) END")
    for i, c in enumerate([*presets.FORMATION_COLUMNS, *presets.FORMATION_INTERVALS])]


def formation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "lineitem"), FORMATION_VALUE_EXPRS)


def _chan(x: str) -> str:
    return (f"cast(least(255, greatest(0, floor((CAST({x} AS DOUBLE) + CAST(0.5 AS DOUBLE)) "
            f"* CAST(255 AS DOUBLE)))) AS int)")


# embeddings (64 floats) as an 8 x 8 BGR image; side from label parity
PIXEL_EXPRS = [
    ("image_id", "vec_id"),
    ("side", "CASE WHEN label % 2 = 0 THEN 'home_team' ELSE 'opp_team' END"),
    ("row", "cast(floor(i / 8) AS int)"),
    ("col", "cast(i % 8 AS int)"),
    ("b", _chan("e")),
    ("g", _chan("-e")),
    ("r", _chan("CAST(e AS DOUBLE) * 2")),
    ("gray", _chan("e")),
]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    px = emb.select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return _project(px, PIXEL_EXPRS)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> Spark ``image`` rows (8 x 8, 3 channels, BGR bytes)."""
    emb = table(spark, sf_dir, "embeddings")
    def ch(x):
        return f"lpad(hex({_chan(x)}), 2, '0')"
    hexdata = (f"concat_ws('', transform(embedding, e -> concat({ch('e')}, {ch('-e')}, "
               f"{ch('CAST(e AS DOUBLE) * 2')})))")
    img = F.struct(F.concat(F.lit("emb://"), F.col("vec_id").cast("string")).alias("origin"),
                   F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"),
                   F.lit(16).alias("mode"), F.unhex(F.expr(hexdata)).alias("data"))
    return emb.select(img.alias("image"), F.expr(PIXEL_EXPRS[1][1]).alias("side"))


# orders -> match-report files: team 1 = customer nation, team 2 = nation of
# the order's lowest supplier; each file is listed in both teams' folders.
REPORT_FILE = ("CASE WHEN o_orderkey % 13 = 0 THEN n1 || ' vs ' || n2 || '.pdf' "
               "WHEN o_orderkey % 13 = 1 THEN n1 || ' - ' || n2 || '.PDF' "
               "ELSE n1 || ' - ' || n2 || ' ' || cast(o_orderkey % 5 AS string) || '-' "
               "|| cast(o_orderkey % 3 AS string) || ' #' || cast(o_orderkey AS string) || '.pdf' END")
REPORT_EXPRS = [
    ("path", f"'/reports/' || fn || ' reports/' || {REPORT_FILE}"),
    ("page_count", "24 + cast(o_orderkey % 3 AS int)"),
]
STANDIN_TEAM = "NATION_1"
STANDIN_OWN = "nation_2"


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.min("l_suppkey").alias("l_suppkey")))
    t1 = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n.withColumnRenamed("n_name", "n1"), F.col("c_nationkey") == F.col("n_nationkey"))
          .select("o_orderkey", "n1"))
    t2 = (li.join(s, li.l_suppkey == s.s_suppkey)
          .join(n.withColumnRenamed("n_name", "n2"), F.col("s_nationkey") == F.col("n_nationkey"))
          .select(F.col("l_orderkey").alias("o_orderkey"), "n2"))
    both = t1.join(t2, "o_orderkey").select("*", F.explode(F.array("n1", "n2")).alias("fn"))
    return _project(both, REPORT_EXPRS)


def report_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> the teams whose reports are wanted, by their full names."""
    return table(spark, sf_dir, "nation").selectExpr("n_name || ' United' AS team")


def sql_select(exprs, source: str) -> str:
    cols = ",\n       ".join(f'{e} AS "{n}"' for n, e in exprs)
    return f"SELECT {cols}\nFROM {source}"


PLAYER_MATCH_SQL = sql_select(
    PLAYER_MATCH_EXPRS, "lineitem LEFT JOIN part ON l_partkey = p_partkey")
FORMATION_VALUE_SQL = sql_select(FORMATION_VALUE_EXPRS, "lineitem")
_LO = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
REPORT_SQL = sql_select(REPORT_EXPRS, """(
  SELECT o_orderkey, n1.n_name AS n1, n2.n_name AS n2, unnest([n1.n_name, n2.n_name]) AS fn
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey
  JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o_orderkey
  JOIN supplier ON s_suppkey = li.sk JOIN nation n2 ON s_nationkey = n2.n_nationkey)""")
PIXEL_SQL = sql_select(PIXEL_EXPRS, "(SELECT vec_id, label, unnest(range(len(embedding))) AS i, "
                                    "unnest(embedding) AS e FROM embeddings)")
TEAM_MATCH_SQL = sql_select(TEAM_MATCH_EXPRS, _LO)
LANE_TOKEN_SQL = sql_select(LANE_TOKEN_EXPRS, _LO)
IMAGE_SQL = sql_select(IMAGE_EXPRS, "orders")
FORMATION_TABLE_SQL = sql_select(FORMATION_TABLE_EXPRS, _LO)
FORMATION_LINE_SQL = (sql_select(FORMATION_BLACK_EXPRS, _LO) + "\nUNION ALL\n"
                      + sql_select(FORMATION_BLUE_EXPRS, _LO))
