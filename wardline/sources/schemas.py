"""Columns of the clinical tables that the features and the cohort query use."""

from __future__ import annotations

_STAY = "subject_id long, hadm_id long, stay_id long"
_LAB = "subject_id long, charttime timestamp_ntz"


def _doubles(names: str) -> str:
    return ", ".join(f"{n} double" for n in names.split())


def _ints(names: str) -> str:
    return ", ".join(f"{n} int" for n in names.split())


def _times(names: str) -> str:
    return ", ".join(f"{n} timestamp_ntz" for n in names.split())


# Table and column names.
SCHEMAS: dict[str, str] = {
    "icustay_detail": (
        f"{_STAY}, gender string, race string, "
        f"{_times('dod admittime dischtime icu_intime icu_outtime')}, "
        f"{_ints('hospital_expire_flag icustay_seq')}, "
        f"{_doubles('los_hospital admission_age los_icu')}"
    ),
    "sepsis3": (
        f"stay_id long, {_times('antibiotic_time culture_time suspected_infection_time sofa_time')}, "
        f"{_ints('sofa_score respiration coagulation liver cardiovascular cns renal')}"
    ),
    "diagnoses_icd": "subject_id long, hadm_id long, icd_version int, icd_code string",
    "cohort_stays": (
        f"subject_id long, stay_id long, {_times('icu_intime')}, icustay_seq int, "
        f"{_doubles('los_hospital los_icu admission_age')}"
    ),
    "complete_blood_count": f"{_LAB}, {_doubles('wbc rdw hematocrit hemoglobin platelet')}",
    "blood_diff": f"{_LAB}, {_doubles('lymphocytes_abs neutrophils lymphocytes')}",
    "vital": f"{_LAB}, {_doubles('temperature heart_rate sbp mbp dbp spo2 resp_rate')}",
    "chemistry": (
        f"{_LAB}, {_doubles('glucose chloride sodium albu creatinine bun bicarbonate')}"
    ),
    "enzyme": f"{_LAB}, {_doubles('alt ast bilirubin_total')}",
    "gcs": f"{_LAB}, {_doubles('gcs')}",
    "coagulation": f"{_LAB}, {_doubles('inr ptt')}",
    "bg": f"{_LAB}, {_doubles('baseexcess lactate po2 pco2 pao2fio2ratio ph')}",
    "urine": f"stay_id long, {_times('charttime')}, {_doubles('urineoutput')}",
    "inputs": (
        f"stay_id long, {_times('starttime endtime storetime')}, {_doubles('amount rate')}, "
        "amountuom string, rateuom string, ordercategoryname string, "
        "ordercategorydescription string"
    ),
    "outputs": f"stay_id long, {_times('storetime')}, {_doubles('value')}",
    "norepinephrine_equivalent_dose": (
        f"stay_id long, {_times('endtime')}, {_doubles('norepinephrine_equivalent_dose')}"
    ),
    "rrt": (
        f"stay_id long, {_times('charttime')}, dialysis_type string, "
        f"{_ints('dialysis_present dialysis_active')}"
    ),
    "ventilation": "ventilation_status string",
    "ventilator_setting": f"stay_id long, {_times('charttime')}",
    "sofa": (
        "stay_id long, hr int, "
        + _ints(
            "respiration_24hours coagulation_24hours liver_24hours cardiovascular_24hours "
            "cns_24hours renal_24hours sofa_24hours"
        )
    ),
    "site": (
        f"{_STAY}, "
        + _ints(
            "Septicemia Heart_infection Peritoneal_infection lung_infection fungal_infection "
            "Bacteremia cns_infection Genitourinary_infection soft_tissue_infection "
            "Gastrointestinal_infection upper_respiratory_infection"
        )
    ),
}
