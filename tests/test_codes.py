from conftest import IN_TIME
from pyspark.sql import functions as F

from wardline.operators import codes
from wardline.operators.codebook import CATEGORIES, code_rows, default_codebook, split_literals
from wardline.operators.codes import attach_flags, code_flags, site_class
from wardline.operators.cohort import select_cohort, sepsis_cohort


def flags_of(spark, rows, codebook=None):
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, icd_version int, icd_code string")
    return {r["hadm_id"]: r.asDict() for r in code_flags(df, codebook).collect()}


def test_codebook_sizes():
    rows = code_rows()
    assert len(rows) == len(set(rows))
    counts = {(c, v): 0 for c in CATEGORIES for v in (9, 10)}
    for c, v, _ in rows:
        counts[c, v] += 1
    assert [counts[c, 9] for c in CATEGORIES] == [3, 2, 3, 8, 8, 3, 9, 9, 6, 14, 5]
    assert [counts[c, 10] for c in CATEGORIES] == [17, 7, 13, 27, 38, 4, 29, 0, 104, 25, 1]


def test_flags(spark):
    got = flags_of(
        spark,
        [
            (1, 1, 10, "J189"), (1, 1, 9, "038"), (2, 2, 9, "J189"), (3, 3, 9, "0389"),
            (4, 4, 10, "N390"), (5, 5, 10, "M86642"), (6, 6, 10, "M86149"), (7, 7, 10, None),
        ],
    )
    assert {c for c in CATEGORIES if got[1][c]} == {"lung_infection", "Septicemia"}
    for admission in (2, 3, 4, 6, 7):
        assert not any(got[admission][c] for c in CATEGORIES)
    assert {c for c in CATEGORIES if got[5][c]} == {"soft_tissue_infection"}


def test_extra_codes(spark):
    book = default_codebook(spark, [("Genitourinary_infection", 10, "N390")])
    got = flags_of(spark, [(4, 4, 10, "N390"), (1, 1, 10, "J189")], book)
    assert got[4]["Genitourinary_infection"] == 1
    assert got[1]["lung_infection"] == 1


def test_literals_that_run_together(spark):
    rows = [("Genitourinary_infection", 10, "N390”,”N410"), ("Genitourinary_infection", 10, "N410"), ("soft_tissue_infection", 10, "M86149,M86249"),
            ("soft_tissue_infection", 9, "015"), ("soft_tissue_infection", 9, ""), ("soft_tissue_infection", 9, None), ("soft_tissue_infection", 9, "015”,”015")]
    literals = spark.createDataFrame(rows, "category string, icd_version int, literal string").withColumn("as_written", F.lit("own"))
    assert {tuple(r) for r in split_literals(literals).collect()} == {
        ("Genitourinary_infection", 10, "N390", False), ("Genitourinary_infection", 10, "N410", True),
        ("soft_tissue_infection", 10, "M86149", False), ("soft_tissue_infection", 10, "M86249", False),
        ("soft_tissue_infection", 9, "015", True),
    }
    book = default_codebook(spark, literals=literals)
    diagnoses = spark.createDataFrame(
        [(1, 1, 10, "N390"), (2, 2, 10, "N410"), (3, 3, 10, "M86249"), (4, 4, 10, "J189"), (5, 5, 9, "N390")],
        "subject_id long, hadm_id long, icd_version int, icd_code string",
    )
    for repaired, expected in ((False, {2, 4}), (True, {1, 2, 3, 4})):
        got = code_flags(diagnoses, book, repaired=repaired).collect()
        assert len(got) == 5 and {r["hadm_id"] for r in got if any(r[c] for c in CATEGORIES)} == expected
    assert split_literals(literals.limit(0)).collect() == []


def test_a_large_codebook_is_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "is_small", lambda df: False)
    rows = [(1, 1, 10, "J189"), (1, 1, 9, "038"), (2, 2, 9, "J189"), (5, 5, 10, "M86642"), (7, 7, 10, None)]
    assert flags_of(spark, rows, default_codebook(spark)) == flags_of(spark, rows)


def test_site_class_order_and_missing(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0, 0), (2, 0, 1, 0, 0), (3, 0, 0, 1, 1), (4, 0, 0, 0, 1), (5, 0, 0, 0, 0),
         (6, None, None, None, None)],
        "id int, lung_infection int, Peritoneal_infection int, Gastrointestinal_infection int, "
        "Genitourinary_infection int",
    )
    got = {r["id"]: r["infectionsite"] for r in site_class(df).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 4}


def test_left_join_keeps_admissions_without_diagnoses(spark):
    cohort = spark.createDataFrame([(1, 1), (2, 2)], "stay_id long, hadm_id long")
    diagnoses = spark.createDataFrame(
        [(1, 1, 10, "J189")], "subject_id long, hadm_id long, icd_version int, icd_code string"
    )
    joined = attach_flags(cohort, code_flags(diagnoses))
    got = {r["hadm_id"]: r["lung_infection"] for r in joined.collect()}
    assert got == {1: 1, 2: None}
    assert joined.columns == ["stay_id", "hadm_id", *CATEGORIES]


def test_cohort_limits(spark):
    rows = [(1, 1, 2.0, 5.0, 50.0), (2, 1, 2.0, 5.0, None), (3, 1, 2.0, 0.9, 50.0),
            (4, 1, 2.0, 100.0, 18.0), (5, 1, 2.0, 100.1, 50.0), (6, 2, 2.0, 5.0, 50.0),
            (7, 1, 0.5, 5.0, 50.0)]
    df = spark.createDataFrame(
        rows,
        "stay_id long, icustay_seq int, los_hospital double, los_icu double, admission_age double",
    )
    assert sorted(r["stay_id"] for r in select_cohort(df).collect()) == [1, 4]


def test_sepsis_cohort(spark):
    stays = spark.createDataFrame(
        [(1, 1, s, "F", None, 0, IN_TIME, IN_TIME, 3.0, 40.0, "x", IN_TIME, IN_TIME, 2.0, seq)
         for s, seq in ((1, 1), (2, 2), (3, 1))],
        "subject_id long, hadm_id long, stay_id long, gender string, dod timestamp_ntz, "
        "hospital_expire_flag int, admittime timestamp_ntz, dischtime timestamp_ntz, "
        "los_hospital double, admission_age double, race string, icu_intime timestamp_ntz, "
        "icu_outtime timestamp_ntz, los_icu double, icustay_seq int",
    )
    sepsis = spark.createDataFrame(
        [(s, IN_TIME, IN_TIME, IN_TIME, IN_TIME, 5, 1, 1, 1, 1, 1, 0) for s in (1, 2, 9)],
        "stay_id long, antibiotic_time timestamp_ntz, culture_time timestamp_ntz, "
        "suspected_infection_time timestamp_ntz, sofa_time timestamp_ntz, sofa_score int, "
        "respiration int, coagulation int, liver int, cardiovascular int, cns int, renal int",
    )
    out = sepsis_cohort(stays, sepsis)
    assert [r["stay_id"] for r in out.collect()] == [1]
    assert len(out.columns) == 26
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" in plan and "RightOuter" not in plan
