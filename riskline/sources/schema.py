"""Column lists and types of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The fourteen condition slots, in input order.
CONDITIONS = tuple(f"{j:02d}" for j in range(1, 15))

# Input file column of each condition slot.
CONDITION_COLUMNS = (
    "myocard_infarct_date",
    "cong_heart_fail_date",
    "periph_vas_dis_date",
    "cereb_vas_dis_date",
    "dementia_date",
    "chron_pulm_dis_date",
    "rheumatic_dis_date",
    "peptic_ulcer_date",
    "mild_liv_dis_date",
    "mod_sevr_liver_dis_date",
    "diabt_wo_chron_complict_date",
    "diabt_chron_complict_date",
    "hemiplegia_paraplegia_date",
    "renal_dis_date",
)

# Input file column of each person-table column.
SUBJECT_RENAMES = {
    "first_elig_period_start_date_65": "start_date",
    "first_elig_end_date_65": "end_date",
    "hiv_cms_date_type2": "exposure_date",
    "any_cx_data_type1": "any_date_type1",
    "any_cx_data_type2": "any_date_type2",
    "colon_cx_data_type2": "primary_date",
    "anal_cx_data_type2": "exclusion_date",
    **{raw: f"cond_{c}_date" for raw, c in zip(CONDITION_COLUMNS, CONDITIONS)},
}

# Panel file column of each panel column whose name differs.
PANEL_RENAMES = {
    "hiv_base": "exposed",
    "endo_time": "proc_time",
    "endo": "proc",
    "date_last_endo": "date_last_proc",
    "years_between_endo": "years_since_proc",
    "prior_endo": "prior_proc",
}

# Event labels used in panel files.
EVENT_LABELS = {"colon": "primary", "dead": "competing", "censor": "censor"}


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_S, _I, _D, _X = T.StringType(), T.IntegerType(), T.DateType(), T.DoubleType()

SUBJECT = _struct(
    ("bene_id", _S), ("race", _I), ("sex", _S), ("first_elig_state", _S),
    ("start_date", _D), ("end_date", _D), ("dob", _D), ("dod", _D), ("exposure_date", _D),
    ("any_date_type1", _D), ("any_date_type2", _D), ("primary_date", _D), ("exclusion_date", _D),
    *[(f"cond_{c}_date", _D) for c in CONDITIONS],
)

PROCEDURE = _struct(("bene_id", _S), ("proc_type", _I), ("proc_date", _D))

PANEL = _struct(
    ("bene_id", _S), ("dob", _D), ("baseline", _D), ("end_date", _D), ("exposed", _I), ("age_base", _I),
    ("yr_base", _I), ("first_elig_state", _S), ("race", _I), ("sex", _S), ("first_event", _S),
    ("event_date", _D), ("event_time", _X), ("event_int", _I), ("int", _I), ("drop", _I),
    ("int_start", _D), ("age_start", _X), ("int_end", _D), ("age_end", _X), ("n_cond", _I),
    ("proc_type", _I), ("proc_time", _X), ("proc", _I), ("date_last_proc", _D),
    ("years_since_proc", _X), ("prior_proc", _I),
)

PANEL_COLUMNS = tuple(PANEL.names)
