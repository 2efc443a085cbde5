"""Analytics over shot records: filter, per-team sums, a density grid."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from poolwright.functions.lower import ascii_folded
from poolwright.functions.predicate import TRUE, Predicate
from poolwright.operators.catalog import Trait
from poolwright.schema import Model

_field = lambda name, kind: T.StructField(name, kind, False)

SHOT = Model("shots.Shot", T.StructType([
    _field("id", T.LongType()), _field("period", T.ShortType()), _field("x", T.IntegerType()), _field("y", T.IntegerType()), _field("xg", T.FloatType()),
    _field("shot_type", T.StringType()), _field("on_rebound", T.BooleanType()), _field("team", T.StringType()), _field("goal", T.BooleanType())]))
TEAM = Model("shots.Team", T.StructType([_field("team", T.StringType()), _field("shots", T.LongType()), _field("goals", T.LongType()), _field("xg_milli", T.LongType())]), key="team")

ROWS = Trait("rows", T.StructType([T.StructField("label", T.StringType()), T.StructField("team", T.StringType())]))

# The dangerous area and the least chance of a goal there.
DANGER_X, DANGER_Y, DANGER_XG = (-30, 30), (-15, 15), 0.15
RINK_X, RINK_Y = 100, 42


def high_danger() -> Predicate:
    f = SHOT.fields
    return f.x.between(*DANGER_X) & f.y.between(*DANGER_Y) & f.xg.gte(DANGER_XG)


def shot_filter(*, period: int | None = None, team: str | None = None, danger: bool = False, goals: bool = False) -> Predicate:
    """The conjunction of the choices made; none: all shots."""
    f, p = SHOT.fields, TRUE
    for chosen, part in ((period is not None, lambda: f.period.eq(period)), (team is not None, lambda: f.team.eq(team)), (danger, high_danger), (goals, lambda: f.goal.eq(True))):
        if chosen:
            p = part() if p is TRUE else p & part()
    return p


def one_timer(kind: Column) -> Column:
    """The words one and timer next to each other, whatever separates them."""
    return F.regexp_like(ascii_folded(kind), F.lit("(^|[^a-z0-9])one[^a-z0-9]+timer([^a-z0-9]|$)"))


def team_summary(shots: DataFrame) -> DataFrame:
    return shots.groupBy("team").agg(
        F.count("*").alias("shots"), F.sum(F.col("goal").cast("long")).alias("goals"), F.sum(F.round(F.col("xg") * 1000).cast("long")).alias("xg_milli"))


def average_xg(shots: Column, xg_milli: Column) -> Column:
    return F.when(shots == 0, F.lit(0.0)).otherwise(xg_milli / shots / 1000)


def heatmap(shots: DataFrame, width: int, height: int, *, x: str = "x", y: str = "y") -> DataFrame:
    """row, col, n of each cell that has shots; shots outside the rink and
    grids without cells count nothing; n stops at 65535."""
    if width < 1 or height < 1:
        return shots.select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("n")).limit(0)
    inside = F.col(x).between(-RINK_X, RINK_X) & F.col(y).between(-RINK_Y, RINK_Y)
    at = lambda c, low, size, cells: F.least(F.greatest(F.round((c.cast("float") + F.lit(float(low)).cast("float")) / F.lit(float(size)).cast("float") * F.lit(float(cells - 1)).cast("float")).cast("int"), F.lit(0)), F.lit(cells - 1))
    cells = shots.where(inside).select(at(-F.col(y), RINK_Y, 2 * RINK_Y, height).alias("row"), at(F.col(x), RINK_X, 2 * RINK_X, width).alias("col"))
    return cells.groupBy("row", "col").agg(F.least(F.count("*"), F.lit(65535)).cast("int").alias("n"))


def max_density(grid: DataFrame) -> int:
    return grid.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def density_at(grid: DataFrame, row: int, col: int) -> int:
    found = grid.where((F.col("row") == row) & (F.col("col") == col)).first()
    return found["n"] if found else 0


@ROWS.implements(SHOT)
def _shot_row() -> dict[str, Column]:
    return {"label": F.format_string("%s #%d", "team", "id"), "team": F.col("team")}


@ROWS.implements(TEAM)
def _team_row() -> dict[str, Column]:
    return {"label": F.format_string("%.2f avg xG", average_xg(F.col("shots"), F.col("xg_milli"))), "team": F.col("team")}


def trait_stats(rows: DataFrame) -> DataFrame:
    """Rows in all and by model, and the first label of each by text."""
    return rows.groupBy("_model").agg(F.count("*").alias("n"), F.min("label").alias("sample"))


def summary_line(shots: DataFrame) -> str:
    r = shots.agg(F.count("*").alias("n"), F.sum(F.col("goal").cast("int")).alias("goals"), F.avg("xg").alias("xg")).first()
    return f"{r['n']} shots, {r['goals'] or 0} goals, {r['xg'] or 0.0:.2f} avg xG"
