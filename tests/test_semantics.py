"""One test per R-vs-Spark semantic rule (blueprint §1.1), on hand-written frames with nulls."""

import datetime as dt
import math

from pyspark.sql import functions as F

from raremetrics.functions import classes as C
from raremetrics.functions import dates as D
from raremetrics.functions import numeric as N
from raremetrics.operators import bins, clean, derive, describe, enrich, summarise


def test_t2_exclusion_keeps_null_ids(spark):
    df = spark.createDataFrame([(1,), (124586,), (None,)], "shot_id long")
    out = {r[0] for r in clean.exclude_ids(df, "shot_id", clean.excluded_shots(spark)).collect()}
    assert out == {1, None}
    rules = spark.createDataFrame([(1,)], "id long")
    assert {r[0] for r in clean.exclude_ids(df, "shot_id", rules).collect()} == {124586, None}


def test_t3_annual_totals_drop_rows_with_any_null(spark):
    df = spark.createDataFrame([(2010, 1, 0, 2.0), (2010, None, 0, 3.0), (2011, 0, 1, None)],
                               "yr int, green long, narrow long, hrs double")
    rows = {r.yr: (r.green, r.hrs) for r in enrich.annual_totals(df).collect()}
    assert rows == {2010: (1, 2.0)}


def test_t6_midpoint_ignores_one_null(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(N.mean_ignoring_null("a", "b")).collect()] == [2.0, 1.0, None]


def test_t8_sd_of_single_row_is_null(spark):
    df = spark.createDataFrame([(2010, 5.0, 1, 0)], "yr int, hrs double, narrow long, green long")
    r = summarise.nominal_cpue(df).filter("species='narrow'").collect()[0]
    assert r.n == 1 and r.sd is None and r.mean == 200.0


def test_t11_round_half_even(spark):
    df = spark.createDataFrame([(45.0,), (55.0,), (200.0,)], "d double")
    assert [r[0] for r in df.select(N.round_to("d", 10)).collect()] == [40.0, 60.0, 200.0]


def test_t12_bad_dates_become_null(spark):
    df = spark.createDataFrame([("1/2/2010", "6:05:00"), ("31/02/2010", "1:00:00"), ("junk", None)],
                               "d string, t string")
    rows = df.select(D.parse_date("d").alias("d"), D.combine_datetime("d", "t").alias("ts")).collect()
    assert rows[0].d == dt.date(2010, 2, 1) and rows[0].ts == dt.datetime(2010, 2, 1, 6, 5)
    assert rows[1].d is None and rows[2].d is None and rows[2].ts is None


def test_p4_effort_hours(spark):
    df = spark.createDataFrame([(dt.datetime(2010, 1, 1, 6, 0), dt.datetime(2010, 1, 1, 8, 30))],
                               "s timestamp_ntz, e timestamp_ntz")
    assert df.select(D.hours_between("s", "e")).collect()[0][0] == 2.5


def test_t14_cell_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-20.19, 116.29)], "lat double, lon double")
    r = derive.with_grid_cell(df, "lat", "lon").collect()[0]
    assert (r.cell_lat, r.cell_lon) == (-20.1, 116.2)
    assert abs(r.centre_lat - (-20.15)) < 1e-12 and abs(r.centre_lon - 116.25) < 1e-12


def test_t15_equal_width_cut_is_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (10.0,)], "x double")
    out = [r.bin for r in bins.equal_width_cut(df, "x", 10).orderBy("x").collect()]
    assert out == [1, 1, 2, 10]


def test_t16_fixed_width_cut(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.51,), (3.0,), (3.2,)], "x double")
    assert [r[0] for r in df.select(N.cut_fixed_width("x", 0.5, 3.0)).collect()] == [None, 1, 2, 6, None]


def test_classes_edges(spark):
    df = spark.createDataFrame([(6, 3, 2.0), (18, 8, 4.0), (19, 9, 1.99), (None, None, None)],
                               "h int, m int, e double")
    rows = df.select(C.day_night("h"), C.season("m"), C.effort_class("e")).collect()
    assert [tuple(r) for r in rows] == [("Day", "AuWin", "Standard"), ("Day", "AuWin", "Long"),
                                         ("Night", "SprSu", "Short"), (None, None, None)]


def test_f3_f4_minimum_effort_and_blank_vessel(spark):
    df = spark.createDataFrame([("a", 10 / 60), ("", 1.0), (None, 1.0), ("b", 0.1)], "vessel string, hrs double")
    out = clean.known_vessel(clean.min_effort(df)).collect()
    assert [r.vessel for r in out] == ["a"]


def test_t21_tenure_needs_more_than_five_years(spark):
    rows = [("five", y) for y in range(2010, 2015)] + [("six", y) for y in range(2010, 2016)]
    df = spark.createDataFrame(rows, "vessel string, yr int")
    assert {r.vessel for r in clean.vessel_tenure(df).collect()} == {"six"}


def test_p8_vessel_alias(spark):
    df = spark.createDataFrame([("Torbay II",), ("TORBAY",), ("",)], "vessel string")
    assert [r[0] for r in derive.normalise_vessel(df).collect()] == ["torbay", "torbay", ""]


def test_t23_effort_bins_zero_fill(spark):
    df = spark.createDataFrame([(0.4, 0, 0), (0.9, 1, 0), (1.2, 0, 0), (0.6, 0, 0)],
                               "hrs double, narrow long, green long")
    out = {r.bin: (r.shots, r.interactions) for r in bins.effort_bins(df).collect()}
    # cap = 0.9 (largest positive effort); bins up to round(0.9)=1 -> (0,0.5],(0.5,1]
    assert out == {1: (1, 0), 2: (2, 1)}


def test_t22_profile_keeps_levels_with_catch_only(spark):
    df = spark.createDataFrame([(1, 2.0, 1, 0), (1, 3.0, 0, 0), (2, 4.0, 0, 0)],
                               "mn int, hrs double, narrow long, green long")
    out = summarise.catch_effort_profile(df, {"mn": "mn"}, ["narrow", "green"]).collect()
    assert [(r.species, r.level, r.catch, r.hrs, r.shots) for r in out] == [("narrow", 1.0, 1, 5.0, 2)]


def test_kde_keeps_groups_of_tied_values(spark):
    rows = [("tied", 2.0)] * 8 + [("tied", 1.0), ("tied", 5.0)] + [("same", -3.0)] * 4 + [("zero", 0.0)] * 4 + [("one", 1.0)]
    got = describe.kde(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()
    assert {r.g for r in got} == {"tied", "same", "zero"}
    scale = {"tied": 1.0327955589886446, "same": 3.0, "zero": 1.0}
    for g, n in (("tied", 10), ("same", 4), ("zero", 4)):
        bw = 0.9 * scale[g] * n ** -0.2
        at = {r.point: r.x for r in got if r.g == g}
        low = min(v for k, v in rows if k == g)
        assert abs(at[0] - (low - 3 * bw)) < 1e-9


def test_kde_is_a_density_without_a_cut(spark):
    values = [0.5 * (i % 7) + 0.01 * i for i in range(200)] + [40.0]
    got = sorted(describe.kde(spark.createDataFrame([(v,) for v in values], "v double"), "v", bandwidth=0.7).collect(),
                 key=lambda r: r.point)
    assert len(got) == describe.KDE_POINTS

    def exact(x):
        return sum(math.exp(-0.5 * ((x - v) / 0.7) ** 2) for v in values) / (len(values) * 0.7 * math.sqrt(2 * math.pi))

    assert all(abs(r.density - exact(r.x)) < 2e-4 for r in got)
    assert got[200].density > 0.0 and exact(got[200].x) < 1e-9  # 15 and more bandwidths from any value
    step = got[1].x - got[0].x
    assert abs(sum(r.density for r in got) * step - 1) < 2e-3


def test_kde_sums_the_kernel_over_the_values_themselves(spark):
    values = [0.013 * i * i for i in range(40)]
    got = describe.kde(spark.createDataFrame([(v,) for v in values], "v double"), "v", bandwidth=0.2).collect()
    assert len(got) == describe.KDE_POINTS
    for r in got:
        want = sum(math.exp(-0.5 * ((r.x - v) / 0.2) ** 2) for v in values) / (len(values) * 0.2 * math.sqrt(2 * math.pi))
        assert abs(r.density - want) < 1e-12


def test_end_date_rolls_over_midnight_and_months(spark):
    rows = [(dt.date(1999, 12, 31), 23, 1.0), (dt.date(1999, 12, 31), 20, 3.9), (dt.date(2000, 2, 28), 0, 49.0), (None, 1, 1.0), (dt.date(2000, 1, 1), 3, None)]
    got = spark.createDataFrame(rows, "d date, h int, hrs double").select(D.end_date("d", "h", "hrs")).collect()
    assert [r[0] for r in got] == [dt.date(2000, 1, 1), dt.date(1999, 12, 31), dt.date(2000, 3, 1), None, None]
