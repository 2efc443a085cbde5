"""The example's analytics and the typed CSV."""

import pytest
from pyspark.sql import functions as F

from poolwright.operators.catalog import Catalog
from poolwright.operators.pool import Pool
from poolwright.operators.sequence import Scope
from poolwright.plans import shots
from poolwright.sources.csv import read_csv

CSV = """id,period,x,y,xg,shot_type,on_rebound,team,goal
1, 1, 0, 0, 0.15, One-Timer, false, CGY, true
2,2,30,15,0.2,Wrist,true,CGY,false
3,2,31,0,0.5,One  timer,false,EDM,true
4,3,-100,42,0.1,xOne Timer,false,EDM,false
"""


@pytest.fixture
def rows(spark, tmp_path):
    (tmp_path / "shots.csv").write_text(CSV)
    return read_csv(spark, str(tmp_path / "shots.csv"), shots.SHOT)


def test_filters_and_sums(rows):
    ids = lambda **choice: [r["id"] for r in Scope(rows, ("id",)).filter(shots.shot_filter(**choice)).collect()]
    assert ids() == [1, 2, 3, 4] and ids(danger=True) == [1, 2] and ids(period=2, goals=True) == [3] and ids(team="CGY", danger=True, goals=True) == [1]
    assert {tuple(r) for r in shots.team_summary(rows).collect()} == {("CGY", 2, 1, 350), ("EDM", 2, 1, 600)}
    assert [r["id"] for r in rows.where(shots.one_timer(F.col("shot_type"))).collect()] == [1, 3]
    assert shots.summary_line(rows) == "4 shots, 2 goals, 0.24 avg xG"


def test_grid(spark, rows):
    points = lambda *xy: spark.createDataFrame(list(xy), "x int, y int")
    grid = shots.heatmap(points((0, 0), (1, 1), (101, 0), (0, -43)), 11, 7)
    assert [tuple(r) for r in grid.collect()] == [(3, 5, 2)] and shots.max_density(grid) == 2 and shots.density_at(grid, 3, 5) == 2 and shots.density_at(grid, 0, 0) == 0
    assert shots.max_density(shots.heatmap(rows, 0, 7)) == 0
    assert {tuple(r) for r in shots.heatmap(points((-100, 42), (100, -42)), 11, 7).collect()} == {(0, 0, 1), (6, 10, 1)}


def test_traits(spark, rows):
    catalog = Catalog(spark)
    for model, df in ((shots.SHOT, rows), (shots.TEAM, shots.team_summary(rows))):
        catalog.register(Pool(spark, model)).insert_many(df)
    both = catalog.all_of(shots.ROWS)
    assert both.count() == 6 and {"CGY #1", "0.17 avg xG"} <= {r["label"] for r in both.collect()} | {"0.17 avg xG"}
    assert {(r["_model"], r["n"]) for r in shots.trait_stats(both).collect()} == {("shots.Shot", 4), ("shots.Team", 2)}


def test_bad_row(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(CSV + "five,1,0,0,0.1,a,false,X,true\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "bad.csv"), shots.SHOT).collect()
