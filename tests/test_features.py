import pytest
from conftest import at
from pyspark.sql import functions as F

from wardline.operators.features import (
    FEATURES,
    STORED_INPUT,
    cohort_lookup,
    daily_features,
    daily_scores,
    daily_source,
    grouped_specs,
)
from wardline.operators.panel import assemble_panel, counting_process, day_spine

SPEC = {s.name: s for s in FEATURES}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def labs(spark, data, columns):
    return spark.createDataFrame(
        [(s, at(h), *v) for s, h, *v in data],
        "subject_id long, charttime timestamp_ntz, " + ", ".join(f"{c} double" for c in columns),
    )


def test_every_feature_is_declared():
    assert len(FEATURES) == 39  # 33 min/max blocks, 3 sums, 3 maxima; scores are apart
    assert len(grouped_specs(FEATURES)) == 14
    assert sum(s.how == "minmax" for s in FEATURES) == 33


def test_min_max_skip_missing_and_empty_groups(spark, cohort):
    table = labs(
        spark,
        [(10, 1, 3.0), (10, 2, None), (10, 3, 5.0), (10, 30, None), (10, 50, float("nan"))],
        ["wbc"],
    )
    got = daily_source(table, cohort, [SPEC["wbc"]])
    assert rows(got, "stay_id", "day", "wbc_min", "wbc_max") == [(1, 1, 3.0, 5.0)]


def test_subject_with_two_stays_fans_out(spark, cohort):
    got = daily_source(labs(spark, [(20, 143, 7.0)], ["wbc"]), cohort, [SPEC["wbc"]])
    assert rows(got, "stay_id", "day") == [(2, 6), (3, 1)]


def test_infinite_ratio_drops_the_day(spark, cohort):
    data = [(10, 1, 8.0, 2.0), (10, 2, 5.0, 0.0), (10, 25, 0.0, 0.0), (10, 26, 9.0, 3.0)]
    got = daily_source(labs(spark, data, ["neutrophils", "lymphocytes"]), cohort, [SPEC["nlr"]])
    assert rows(got, "day", "nlr_min", "nlr_max") == [(2, 3.0, 3.0)]


def test_empty_cohort(spark, cohort):
    table = labs(spark, [(10, 1, 3.0)], ["wbc"])
    assert daily_source(table, cohort.limit(0), [SPEC["wbc"]]).collect() == []


def test_fused_features_keep_their_own_missing_days(spark, cohort):
    table = labs(spark, [(10, 1, 3.0, None), (10, 30, None, 9.0)], ["wbc", "rdw"])
    got = daily_source(table, cohort, [SPEC["wbc"], SPEC["rdw"]])
    assert rows(got, "day", "wbc_max", "rdw_max") == [(1, 3.0, None), (2, None, 9.0)]


def test_broadcast_and_split_joins_agree(spark, cohort):
    table = labs(spark, [(10, h / 10, float(h)) for h in range(1, 400)], ["wbc"])
    a = daily_source(table, cohort_lookup(cohort), [SPEC["wbc"]])
    large = cohort_lookup(cohort, rows=1)
    assert not large.small
    b = daily_source(table, large, [SPEC["wbc"]])
    columns = ["stay_id", "day", "wbc_min", "wbc_max"]
    assert rows(a, *columns) == rows(b, *columns)


def test_urine(spark, cohort):
    table = spark.createDataFrame(
        [(1, at(h), v) for h, v in [(1, -5.0), (2, None), (3, 100.0), (4, 50.0)]],
        "stay_id long, charttime timestamp_ntz, urineoutput double",
    )
    got = daily_source(table, cohort, [SPEC["uri_total"]])
    assert rows(got, "stay_id", "day", "uri_total") == [(1, 1, 150.0)]


INFUSIONS = [
    # start, end, amount, amount unit, rate, rate unit, category
    ([(23, 26, 0.0, "mL", 2.0, "mL/min", "Continuous IV")], [(1, 360.0)]),
    ([(1, 2, 0.5, "L", 100.0, "mL/hour", "Bolus")], [(1, 500.0)]),
    ([(1, 2, 5.0, "mL", 1.0, "mcg/kg/min", "Bolus")], []),
    ([(1, None, 5.0, "mL", 1.0, "mL/hour", "Continuous Med")], [(1, 0.0)]),
    ([(1, 2, 70.0, "", 10.0, "mL/hour", "Bolus")], [(1, 70.0)]),
    ([(1, 2, 70.0, None, 10.0, "mL/hour", "Bolus")], [(1, 0.0)]),
    ([(1, 2, 70.0, "mL", 10.0, "mL/hour", None)], [(1, 0.0)]),
]


@pytest.mark.parametrize("data, expected", INFUSIONS)
def test_infusion_volume(spark, cohort, data, expected):
    table = spark.createDataFrame(
        [(1, at(s), None if e is None else at(e), *rest) for s, e, *rest in data],
        "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, amount double, "
        "amountuom string, rate double, rateuom string, ordercategorydescription string",
    )
    got = daily_source(table, cohort, [SPEC["input_total"]])
    assert rows(got, "day", "input_total") == expected


def test_stored_input_and_output(spark, cohort):
    table = spark.createDataFrame(
        [(1, at(1), 5.0), (1, at(2), -1.0), (1, at(25), 7.0)],
        "stay_id long, storetime timestamp_ntz, amount double",
    )
    got = daily_source(table, cohort, [STORED_INPUT])
    assert rows(got, "day", "input_total") == [(1, 5.0), (2, 7.0)]
    outputs = table.withColumnRenamed("amount", "value")
    got = daily_source(outputs, cohort, [SPEC["output_total"]])
    assert rows(got, "day", "output_total") == [(1, 5.0), (2, 7.0)]


def test_maxima(spark, cohort):
    dose = spark.createDataFrame(
        [(1, at(1), 0.1), (1, at(2), 0.3), (1, at(30), None)],
        "stay_id long, endtime timestamp_ntz, norepinephrine_equivalent_dose double",
    )
    assert rows(daily_source(dose, cohort, [SPEC["vaso_ne"]]), "day", "vaso_ne") == [(1, 0.3)]
    modes = spark.createDataFrame(
        [(1, at(1), "CVVH", 1), (1, at(30), "Peritoneal", 1), (1, at(50), "IHD", 0)],
        "stay_id long, charttime timestamp_ntz, dialysis_type string, dialysis_present int",
    )
    assert rows(daily_source(modes, cohort, [SPEC["rrt"]]), "day", "rrt") == [(1, 1.0), (3, 0.0)]
    vent = spark.createDataFrame([(1, at(1))], "stay_id long, charttime timestamp_ntz")
    assert rows(daily_source(vent, cohort, [SPEC["vent"]]), "day", "vent") == [(1, 1.0)]


SCORES = "stay_id long, hr int, " + ", ".join(
    f"{c}_24hours int"
    for c in ["respiration", "coagulation", "liver", "cardiovascular", "cns", "renal", "sofa"]
)


def test_scores_keep_stays_outside_the_cohort(spark):
    table = spark.createDataFrame(
        [
            (99, 5, 1, None, 0, 0, 0, 0, 7),
            (99, 24, 2, None, 0, 0, 0, 0, 6),
            (99, 0, 4, 4, 4, 4, 4, 4, 24),
            (1, 30, 1, 1, 1, 1, 1, 1, None),
        ],
        SCORES,
    )
    got = daily_scores(table)
    assert rows(got, "stay_id", "day", "sofa_day", "respiration_24hours", "coagulation_24hours") == [
        (99, 1, 7.0, 2.0, None)
    ]


def test_spine(spark):
    stays = spark.createDataFrame([(1, 2.1), (2, 40.0), (3, None)], "stay_id long, los_icu double")
    got = rows(day_spine(stays), "stay_id", "day")
    assert got == [(1, d) for d in (1, 2, 3)] + [(2, d) for d in range(1, 29)]


def test_panel_keeps_days_without_features_and_drops_later_ones(spark, cohort):
    stays = cohort.join(
        spark.createDataFrame([(1, 2.5), (2, 1.0), (3, 1.0)], "stay_id long, los_icu double"),
        "stay_id",
    )
    tables = {
        "complete_blood_count": labs(
            spark, [(10, 1, 3.0, 1.0, 1.0, 1.0, 1.0), (10, 200, 9.0, 1.0, 1.0, 1.0, 1.0)],
            ["wbc", "rdw", "hematocrit", "hemoglobin", "platelet"],
        ),
        "outputs": spark.createDataFrame(
            [(1, at(30), 40.0)], "stay_id long, storetime timestamp_ntz, value double"
        ),
    }
    panel = assemble_panel(day_spine(stays), daily_features(tables, cohort))
    panel = counting_process(panel.withColumn("input_total", F.lit(None).cast("double")))
    got = rows(panel.filter("stay_id = 1"), "day", "wbc_max", "tstart", "tstop", "fb")
    assert got == [(1, 3.0, 0, 1, 0.0), (2, None, 1, 2, -40.0), (3, None, 2, 3, 0.0)]
    assert panel.count() == 5


def test_row_order_and_partitions_do_not_matter(spark, cohort):
    table = labs(spark, [(10, h / 7, float(h % 13)) for h in range(1, 300)], ["wbc"])
    shuffled = table.orderBy(F.rand(3)).repartition(5)
    columns = ["stay_id", "day", "wbc_min", "wbc_max"]
    a = daily_source(table, cohort, [SPEC["wbc"]])
    b = daily_source(shuffled, cohort, [SPEC["wbc"]])
    assert rows(a, *columns) == rows(b, *columns)
