"""Typed reading of flat extracts and the checks that guard them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from labspark.functions.dates import NTZ
from labspark.functions.predicates import in_range, status_ok
from labspark.functions.values import label_codes
from labspark.sources.records import read_records


class ContractError(ValueError):
    """Input that does not satisfy its contract. ``rows``: every offending row, where there is a table of them."""

    def __init__(self, message: str, rows: DataFrame | None = None):
        super().__init__(message)
        self.rows = rows


@dataclass(frozen=True)
class Field:
    name: str
    source: str
    type: str = "string"
    required: bool = True


S, D, TS = "string", "double", NTZ

# --- fixed values: column names of the extracts ----------------------------------------------
LAB = (
    Field("code", "Observation_code_coding_code"),
    Field("code_system", "Observation_code_coding_system"),
    Field("value", "Observation_value_X_Valuequantity_value", D),
    Field("unit", "Observation_value_X_Valuequantity_code"),
    Field("comparator", "Observation_value_X_Valuequantity_comparator"),
    Field("obs_id", "id"),
    Field("identifier", "Observation_identifierAnalysebefundcode_value"),
    Field("ref_high", "Observation_referenceRange_high_value", D),
    Field("ref_low", "Observation_referenceRange_low_value", D),
    Field("ref_high_unit", "Observation_referenceRange_high_code"),
    Field("ref_low_unit", "Observation_referenceRange_low_code"),
    Field("ref_type", "Observation_referenceRange_type_coding_code"),
    Field("time", "Observation_effective_X_Effectivedatetime", TS),
    Field("issued", "Observation_issued", TS, False),
    Field("patient", "patient"),
    Field("status", "Observation_status"),
    Field("interpretation", "Observation_interpretation_coding_code"),
    Field("value_code", "Observation_value_X_Valuecodeableconcept_coding_code"),
    Field("value_code_system", "Observation_value_X_Valuecodeableconcept_coding_system"),
    Field("specimen_ref", "Observation_specimen_reference"),
    Field("encounter", "Observation_encounter_reference"),
    Field("note", "Observation_note_text", S, False),
    Field("basedon", "Observation_basedOn_reference", S, False),
    Field("method_code", "Observation_method_coding_code"),
    Field("method_system", "Observation_method_coding_system"),
)
PATIENT = (
    Field("pat_id", "id"),
    Field("birth_raw", "Patient_birthDate"),
    Field("gender", "Patient_gender"),
)
SPECIMEN = (
    Field("spec_id", "id"),
    Field("patient", "patient"),
    Field("type", "Specimen_type_codingSct_code", S, False),
    Field("condition", "Specimen_condition_coding_code"),
    Field("condition_system", "Specimen_condition_coding_system"),
)
ENCOUNTER = (
    Field("enc_id", "id"),
    Field("patient", "patient"),
    Field("class", "Encounter_class_code"),
    Field("period_start", "Encounter_period_start", TS),
    Field("period_end", "Encounter_period_end", TS),
    Field("type", "Encounter_type_coding_code"),
    Field("type_system", "Encounter_type_coding_system"),
    Field("status", "Encounter_status"),
)
_ADMINISTRATION = (
    Field("adm_id", "id"),
    Field("patient", "patient"),
    Field("status", "MedicationAdministration_status"),
    Field("period_start", "MedicationAdministration_effective_X_Effectiveperiod_start", TS),
    Field("period_end", "MedicationAdministration_effective_X_Effectiveperiod_end", TS),
    Field("effective", "MedicationAdministration_effective_X_Effectivedatetime", TS),
    Field("encounter", "MedicationAdministration_context_reference"),
)
ADMINISTRATION_CODED = _ADMINISTRATION + (
    Field("code", "MedicationAdministration_medication_X_Medicationcodeableconcept_codingAtcclassde_code"),
)
ADMINISTRATION_REF = _ADMINISTRATION + (
    Field("med_ref", "MedicationAdministration_medication_X_Medicationreference_reference"),
)
MEDICATION = (
    Field("med_id", "id"),
    Field("code", "Medication_code_codingAtcclassde_code"),
    Field("med_med_ref", "Medication_ingredient_item_X_Itemreference_reference"),
)
PROCEDURE = (
    Field("pro_id", "id"),
    Field("patient", "patient"),
    Field("status", "Procedure_status"),
    Field("ops", "Procedure_code_codingOps_code"),
    Field("snomed", "Procedure_code_codingSct_code"),
    Field("period_start", "Procedure_performed_X_Performedperiod_start", TS),
    Field("period_end", "Procedure_performed_X_Performedperiod_end", TS),
    Field("performed", "Procedure_performed_X_Performeddatetime", TS),
    Field("encounter", "Procedure_encounter_reference"),
)
PROCEDURE_ICU = tuple(Field(f.name, f.source, f.type, f.name != "performed") for f in PROCEDURE)
DEVICE_OBS = (
    Field("pro_id", "id"),
    Field("performed", "Observation_effective_X_Effectivedatetime", TS),
    Field("patient", "patient"),
    Field("status", "Observation_status"),
    Field("period_start", "Observation_effective_X_Effectiveperiod_start", TS),
    Field("period_end", "Observation_effective_X_Effectiveperiod_end", TS),
    Field("encounter", "Observation_encounter_reference"),
)
CONDITION = (
    Field("con_id", "id"),
    Field("patient", "patient"),
    Field("status", "Condition_clinicalStatus_coding_code"),
    Field("verification", "Condition_verificationStatus_coding_code"),
    Field("icd", "Condition_code_codingIcd10gm_code"),
    Field("time", "Condition_recordedDate", TS),
    Field("encounter", "Condition_encounter_reference"),
)

# --- fixed values: file names of the extracts ------------------------------------------------
FILES = {
    "lab": ("Laborwerte.csv", LAB),
    "patients": ("Kalium Patienten.csv", PATIENT),
    "specimens": ("Bioproben.csv", SPECIMEN),
    "encounters": ("Fall.csv", ENCOUNTER),
    "procedures": ("Prozeduren.csv", PROCEDURE),
    "procedures_icu": ("Prozeduren ICU.csv", PROCEDURE_ICU),
    "device_obs": ("Haemodialyse.csv", DEVICE_OBS),
    "conditions": ("Conditions.csv", CONDITION),
    "adm_coded": ("Administration Codeableconcept.csv", ADMINISTRATION_CODED),
    "adm_one_hop": ("Administration MedicationCode.csv", ADMINISTRATION_REF),
    "adm_two_hop": ("Administration Complex.csv", ADMINISTRATION_REF),
    "medication": ("Medikation.csv", MEDICATION),
}
MANDATORY = ("lab", "patients")
EXAMPLES = 5  # rows named in a message; the error carries all of them
UNIT_COLUMNS = ("label", "source_unit", "target_unit", "factor")


def read_strings(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """CSV with a header, every column as text.

    Quoted cells may hold line breaks. A file is then read by one task, so large extracts should be converted
    once (``convert_all`` splits files, see ``records``). Without ``line_breaks`` files are split here too,
    which is right only where no cell has one.
    """
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", line_breaks).csv(path))


def typed(df: DataFrame, fields) -> DataFrame:
    """Selects and casts the fields; a missing optional one becomes a typed NULL.

    Text that does not fit its type becomes NULL (``unparseable`` counts such cells).
    """
    def column(f: Field):
        if f.source not in df.columns:
            return F.lit(None).cast(f.type).alias(f.name)
        c = F.col(f"`{f.source}`")
        return (c if f.type == S else c.try_cast(f.type)).alias(f.name)

    return df.select(*[column(f) for f in fields])


def read_source(spark: SparkSession, path: str, fields, reader=read_strings) -> DataFrame:
    raw = reader(spark, path)
    require_columns({path: raw}, {path: fields})
    return typed(raw, fields)


def unparseable(df: DataFrame, fields) -> DataFrame:
    """Filled cells per typed column that cannot be read as their type: (column_name, n)."""
    wanted = [f for f in fields if f.type != S and f.source in df.columns]
    cols = [F.count_if(F.nullif(F.trim(F.col(f"`{f.source}`")), F.lit("")).isNotNull()
                       & F.col(f"`{f.source}`").try_cast(f.type).isNull()).alias(f.name) for f in wanted]
    return df.agg(*cols).unpivot([], [f.name for f in wanted], "column_name", "n")


def missing_columns(df: DataFrame, fields) -> list[str]:
    return sorted({f.source for f in fields if f.required} - set(df.columns))


def check_columns(sources: dict[str, DataFrame], contracts: dict) -> DataFrame | None:
    """(source, missing) for every required column that is absent; None without any source."""
    parts = []
    for name, df in sources.items():
        # schema checks touch no rows; one row per missing column comes out
        lack = missing_columns(df, contracts[name])
        parts.append(df.sparkSession.createDataFrame([(name, c) for c in lack], "source string, missing string"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def require_columns(sources: dict[str, DataFrame], contracts: dict) -> None:
    bad = {n: lack for n, df in sources.items() if (lack := missing_columns(df, contracts[n]))}
    if bad:
        raise ContractError("missing columns: " + "; ".join(f"{n}: {', '.join(c)}" for n, c in bad.items()))


def _if_there(read) -> DataFrame | None:
    """The table, or None when its path does not exist."""
    try:
        return read()
    except ContractError:
        raise
    except Exception as e:  # the reader names a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_all(spark: SparkSession, folder: str, files: dict | None = None, reader=read_strings) -> dict[str, DataFrame | None]:
    """Every extract of a folder; absent optional files give None. ``reader`` is ``read_strings`` or ``records.read_records``."""
    out = {}
    for name, (file, fields) in (files or FILES).items():
        path = f"{folder.rstrip('/')}/{file}"
        out[name] = _if_there(lambda p=path, f=fields: read_source(spark, p, f, reader))
    lack = [n for n in MANDATORY if out.get(n) is None]
    if lack:
        raise ContractError(f"mandatory files missing: {', '.join(lack)}")
    return out


def convert_all(spark: SparkSession, folder: str, target: str, files: dict | None = None) -> None:
    """Stores every extract of a folder as typed Parquet below ``target``, to be read by ``read_converted``. Each file is read by many tasks."""
    for name, df in read_all(spark, folder, files, read_records).items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")


def read_converted(spark: SparkSession, target: str, files: dict | None = None) -> dict[str, DataFrame | None]:
    """What ``convert_all`` stored; absent sources give None."""
    return {name: _if_there(lambda n=name: spark.read.parquet(f"{target.rstrip('/')}/{n}")) for name in files or FILES}


# --- unit conversion -------------------------------------------------------------------------
def clean_units(raw: DataFrame) -> DataFrame:
    """Trimmed text columns of a conversion table."""
    lack = [c for c in UNIT_COLUMNS if c not in raw.columns]
    if lack:
        raise ContractError(f"unit table has missing columns: {', '.join(lack)}")
    text = {c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in UNIT_COLUMNS[:3]}
    return raw.select(*[c.alias(n) for n, c in text.items()],
                      F.nullif(F.trim(F.col("factor").cast("string")), F.lit("")).alias("factor"))


def unit_problems(units: DataFrame) -> DataFrame:
    """Rows that break a rule of the conversion table, as (problem, label, source_unit)."""
    real = units.filter(F.col("target_unit") != "invalid")
    entries = lambda df, name: df.select(F.lit(name).alias("problem"), "label", "source_unit")
    dup = units.groupBy("label", "source_unit").count().filter("count > 1")
    text = real.filter(F.col("factor").isNotNull() & F.col("factor").try_cast(D).isNull())
    none = real.filter(F.col("factor").isNull())
    targets = real.groupBy("label").agg(F.count_distinct("target_unit").alias("c")).filter("c > 1")
    return reduce(DataFrame.unionByName, [
        entries(dup, "duplicate"), entries(text, "non_numeric_factor"), entries(none, "missing_factor"),
        entries(targets.withColumn("source_unit", F.lit(None).cast(S)), "several_targets")])


def _refuse(what: str, rows: DataFrame) -> None:
    """Raises when there are offending rows: the exact number, a few examples, and all of them on the error."""
    n = rows.count()
    if n:
        some = "; ".join(" ".join(str(v) for v in r if v is not None) for r in rows.orderBy(*rows.columns).take(EXAMPLES))
        raise ContractError(f"{what}: {n} entries, for example {some}", rows)


def load_units(raw: DataFrame) -> DataFrame:
    """Checked conversion table with numeric factors."""
    units = clean_units(raw)
    _refuse("unit table", unit_problems(units))
    return units.withColumn("factor", F.col("factor").try_cast(D))


def unit_usage(df: DataFrame, units: DataFrame, label="label", unit="unit") -> DataFrame:
    """Distinct (label, unit) of the data and how the table treats them: ok, invalid or missing."""
    used = df.filter(F.col(label).isNotNull() & F.col(unit).isNotNull()).select(label, unit).distinct()
    conv = units.select(F.col("label").alias("__l"), F.col("source_unit").alias("__u"), "target_unit")
    joined = used.join(conv, (used[label] == conv["__l"]) & (used[unit] == conv["__u"]), "left")
    state = (F.when(F.col("target_unit").isNull(), "missing").when(F.col("target_unit") == "invalid", "invalid")
             .otherwise("ok"))
    return joined.select(label, unit, state.alias("state"))


def check_units(df: DataFrame, units: DataFrame, label="label", unit="unit") -> DataFrame:
    """Raises when a unit of the data is not in the table; returns ``unit_usage``."""
    usage = unit_usage(df, units, label, unit)
    _refuse("units without conversion", usage.filter("state = 'missing'").drop("state"))
    return usage


def labelled_units(lab: DataFrame, groups: dict, t_min, t_max, system: str, excluded) -> DataFrame:
    """Units per label of the usable measurements, the input of ``check_units``."""
    rows = lab.filter(status_ok("status", excluded) & (F.col("code_system") == system) & in_range("time", t_min, t_max))
    return rows.select(label_codes("code", groups).alias("label"), "unit").filter(F.col("label").isNotNull())


# --- sinks -----------------------------------------------------------------------------------
def write_result(df: DataFrame, path: str, order=None) -> None:
    """A result table as one CSV file with a header. Results are small aggregates."""
    # the shuffle comes first, so that one task writes the result but does not compute it
    out = df.orderBy(*order).coalesce(1) if order else df.repartition(1)
    out.write.mode("overwrite").option("header", True).csv(path)
