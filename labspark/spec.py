"""Study parameters: reference ranges, windows, code lists and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Range:
    """Normal range and plausibility limits; None means no bound."""

    low: float | None = None
    high: float | None = None
    low_ext: float | None = None
    high_ext: float | None = None


@dataclass(frozen=True)
class Cuts:
    """Cut-offs that split low values into three grades and high values into four."""

    l2: float
    l1: float
    h1: float
    h2: float
    h3: float


@dataclass(frozen=True)
class Cohort:
    """Age band and gender; None means no restriction."""

    age_min: int | None = None
    age_max: int | None = None
    gender: str | None = None


# --- fixed values: ranges, cut-offs, windows -------------------------------------------------
MAIN_LABEL = "kalium"
MAIN_RANGE = Range(3.5, 5.0, 1.5, 9.0)
MAIN_CUTS = Cuts(l2=2.5, l1=3.0, h1=5.5, h2=6.0, h3=6.5)
LAB_RANGES = {
    "glucose": Range(70.0, 110.0, 10.0, 800.0),
    "bicarbonat": Range(21.0, 26.0, 5.0, 50.0),
    "pH": Range(7.35, 7.45, 6.8, 7.8),
    "crea": Range(None, None, 0.1, 18.0),
    "GFR": Range(60.0, None, 1.0, 250.0),
}
LAB_WINDOWS = {"glucose": 6, "bicarbonat": 6, "pH": 6, "crea": 48, "GFR": 48}
# labels whose unit may be missing or unlisted: the raw value is used then
UNIT_OPTIONAL_LABELS = ("pH", "GFR")
PERCENTILES = {
    "p01": 0.01, "p05": 0.05, "p10": 0.10, "p15": 0.15, "p20": 0.20, "p25": 0.25, "p30": 0.30,
    "p35": 0.35, "p40": 0.40, "p45": 0.45, "p50": 0.50, "p55": 0.55, "p60": 0.60, "p65": 0.65,
    "p70": 0.70, "p75": 0.75, "p80": 0.80, "p85": 0.85, "p90": 0.90, "p95": 0.95, "p99": 0.99,
    "p99_95": 0.9995, "p0_05": 0.0005,
}
AGE_BANDS = ((None, None), (0, 0), (1, 5), (6, 12), (13, 17), (18, 39), (40, 64), (65, 120))
GENDERS = (None, "female", "male")

# --- fixed values: status lists, code systems ------------------------------------------------
OBS_EXCLUDED = ("cancelled", "entered-in-error")
ENC_EXCLUDED = ("planned", "cancelled", "entered-in-error")
MED_EXCLUDED = ("not-done", "on-hold", "entered-in-error", "stopped")
PROC_EXCLUDED = ("stopped", "entered-in-error", "on-hold", "preparation", "not-done")
DEVICE_OBS_EXCLUDED = ("registered", "preliminary", "cancelled", "entered-in-error")
COND_EXCLUDED = ("inactive", "remission")
COND_VERIFICATION_EXCLUDED = ("unconfirmed", "provisional", "differential", "refuted", "entered-in-error")
LOINC_SYSTEM = "http://loinc.org"
ENC_TYPE_SYSTEM = "http://fhir.de/CodeSystem/Kontaktebene"
MAIN_ENC_TYPE = "einrichtungskontakt"
INPATIENT_CLASSES = ("IMP", "SS")
COMPARATORS = ("<", "<=", ">", ">=")

# --- fixed values: code lists ----------------------------------------------------------------
MAIN_CODES = (
    "12812-4", "12813-2", "2823-3", "29349-8", "32713-0", "39789-3", "39790-1", "41656-0",
    "51618-7", "6298-4", "75940-7", "77142-8",
)
SERUM_CODES = ("2823-3", "12812-4", "12813-2", "29349-8", "51618-7")
BLOOD_CODES = ("6298-4", "39789-3", "39790-1", "32713-0", "41656-0", "75940-7")
QUALITY_CODES = ("20392-7", "20393-5", "20394-3", "20395-0", "46424-8", "46425-5", "46426-3")
LAB_CODES = {
    "glucose": (
        "100746-7", "104597-0", "104598-8", "104655-6", "14743-9", "14749-6", "15074-8", "2339-0",
        "2340-8", "2341-6", "2345-7", "32016-8", "39480-9", "39481-7", "41651-1", "41652-9",
        "41653-7", "47995-6", "51596-5", "72516-8", "74774-1", "77135-2",
    ),
    "bicarbonat": (
        "14151-5", "14627-4", "19229-4", "19230-2", "19231-0", "19232-8", "19233-6", "1959-6",
        "1960-4", "1961-2", "1963-8", "28640-1", "28641-9", "39459-3", "39460-1", "48631-6",
        "54359-5", "69964-5", "97543-3", "97544-1",
    ),
    "pH": (
        "11558-4", "14873-4", "19213-8", "2744-1", "2745-8", "2746-6", "2753-2", "28646-8",
        "28647-6", "33913-5", "97536-7",
    ),
    "crea": (
        "101475-2", "103616-9", "14682-9", "21232-4", "2160-0", "38483-4", "59826-8", "77140-2",
    ),
    "GFR": (
        "102097-3", "48642-3", "48643-1", "50044-7", "50210-4", "50384-7", "62238-1", "69405-9",
        "70969-1", "77147-7", "78006-4", "88293-6", "88294-4", "94677-2", "96591-3", "96592-1",
        "98979-8", "98980-6",
    ),
}
PROCEDURE_PREFIXES = ("8-853", "8-854", "8-855", "8-857")
PROCEDURE_SNOMED = (
    "265764009", "341939001", "302497006", "233586004", "233581009", "714749008", "233578004",
    "233575001", "233588003", "233583007", "182750009", "233579007", "233580005", "708932005",
    "427053002", "57274006", "233577009", "233576000", "11932001", "698074000", "233589006",
    "233590002", "708933000", "233587008", "708930002", "233584001", "233585000", "715743002",
    "233582002", "708934006",
)
MEDICATION_GROUPS = {
    "betabl": ("C07",),
    "digit": ("C01AA",),
    "aminos": ("B05BB01",),
    "osmodi": ("B05BC",),
    "suxame": ("M03AB01",),
    "ras": ("C09",),
    "nsar": ("M01A", "M01B"),
    "calcin": ("L04AD",),
    "hepar": ("B01AB",),
    "diuretksp": ("C03D", "C03E"),
    "diuret": ("C03A", "C03B", "C03C", "C03X"),
    "trimet": ("J01EA01",),
    "pentam": ("P01CX01",),
    "kcliv": ("B05XA01",),
    "kalium": ("A12BA",),
    "pencg": ("J01CE01",),
    "blutpr": ("B05AX",),
    "insul": ("A10A",),
    "gluc": ("B05BA11",),
    "inhsym": ("R03A",),
    "cagluc": ("B05XA19",),
    "antaci": ("A02AH",),
    "mcort": ("H02AA", "H02BX20", "H02BX21"),
    "hyperk": ("V03AE",),
    "laxans": ("A06",),
    "syssym": ("R03C",),
}
TREATMENT_GROUPS = ("gluc", "insul", "hyperk")
CONDITION_GROUPS = {
    "ckd": ("N18",),
    "aki": ("N17",),
    "dka": ("E10.1", "E11.1"),
    "hypald": ("E26.0",),
    "hpoald": ("E27.1",),
    "dm1": ("E10",),
    "dm2": ("E11",),
    "metaz": ("E87.2",),
    "respak": ("E87.3",),
    "hypomg": ("E83.4",),
    "hyperkd": ("E87.5",),
    "hypok": ("E87.6",),
    "neonk": ("P74.3",),
    "leuk": ("C91", "C92"),
    "thromb": ("D47.3",),
    "abnmin": ("R79.0",),
    "gastro": ("A09",),
    "alkblt": ("R78.0",),
    "hkpp": ("G72.3",),
}
# condition groups that are part of another group and so do not count for "only one"
NESTED_CONDITION_GROUPS = ("dka",)
NOTE_SNIPPETS = ("hämol", "haemol", "hemol")


@dataclass(frozen=True)
class Spec:
    """Everything the composite plans need to know about a study."""

    t_min: datetime = datetime(2019, 1, 1)
    t_max: datetime = datetime(2024, 12, 31, 23, 59, 59)
    k: int = 5
    digits: int = 3
    mad_cutoff: float = 15.0
    min_age: int = 1  # ages above this value are kept
    main_label: str = MAIN_LABEL
    main_range: Range = MAIN_RANGE
    main_cuts: Cuts = MAIN_CUTS
    main_codes: tuple = MAIN_CODES
    serum_codes: tuple = SERUM_CODES
    blood_codes: tuple = BLOOD_CODES
    quality_codes: tuple = QUALITY_CODES
    lab_codes: dict = field(default_factory=lambda: dict(LAB_CODES))
    lab_ranges: dict = field(default_factory=lambda: dict(LAB_RANGES))
    lab_windows: dict = field(default_factory=lambda: dict(LAB_WINDOWS))
    unit_optional: tuple = UNIT_OPTIONAL_LABELS
    medication_groups: dict = field(default_factory=lambda: dict(MEDICATION_GROUPS))
    treatment_groups: tuple = TREATMENT_GROUPS
    condition_groups: dict = field(default_factory=lambda: dict(CONDITION_GROUPS))
    nested_conditions: tuple = NESTED_CONDITION_GROUPS
    platelet_group: str = "thromb"
    procedure_prefixes: tuple = PROCEDURE_PREFIXES
    procedure_snomed: tuple = PROCEDURE_SNOMED
    note_snippets: tuple = NOTE_SNIPPETS
    medication_hours: int = 24
    treatment_hours: int = 12
    procedure_hours: int = 12
    pair_hours: int = 6
    followup_hours: int = 120
    system: str = LOINC_SYSTEM
    enc_system: str = ENC_TYPE_SYSTEM
    main_enc_type: str = MAIN_ENC_TYPE
