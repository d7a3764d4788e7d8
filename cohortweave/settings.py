"""All tunable values of the cohort build, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: codeset ids, recodes and category groups of the data model ---
COMORBIDITY_CODESETS = (
    535274723, 359043664, 78746470, 719585646, 403438288, 73549360,
    494981955, 248333963, 378462283, 259495957, 489555336, 510748896,
    514953976, 376881697, 220495690, 7650044049, 652711186,
)
VENTILATION_CODESET = 618758765
ECMO_CODESET = 415149730
DRUG_CODESETS = {
    339287218: "med_paxlovid",
    96369749: "med_remdesivir",
    487953007: "med_bebtelovimab",
    38048732: "med_baricitinib",
    643666235: "med_molnupiravir",
    697105949: "covid_vaccine",
}
CATEGORY_PREFIXES = {"PRG": "PRG"}
CATEGORY_BY_CONCEPT = {4113821: "MBD005", 4195384: "SYM013"}
UNUSABLE_CATEGORY = "XXX111"
RACE_GROUPS = {
    "African American": ("Black or African American", "Black"),
    "Other": (
        "Other Race", "Multiple races", "More than one race", "Hispanic",
        "Multiple race", "Asian Indian",
    ),
    "Unknown": (
        "No information", "Unknown racial group", "No matching concept",
        "Refuse to answer",
    ),
    "Asian or Pacific islander": (
        "Asian", "Other Pacific Islander", "Chinese",
        "Native Hawaiian or Other Pacific Islander",
    ),
}
ETHNICITY_GROUPS = {
    "Other_unknown": (
        "Other/Unknown", "No matching concept", "Unknown", "No information", "Other",
    ),
}
GENDER_GROUPS = {"MALE": ("UNKNOWN", "No matching concept")}
# --- end of fixed values ---


@dataclass(frozen=True)
class CohortSettings:
    comorbidity_codesets: tuple[int, ...] = COMORBIDITY_CODESETS
    ventilation_codeset: int = VENTILATION_CODESET
    ecmo_codeset: int = ECMO_CODESET
    drug_codesets: dict[int, str] = field(default_factory=lambda: dict(DRUG_CODESETS))
    vaccine_flag: str = "covid_vaccine"
    category_prefixes: dict[str, str] = field(default_factory=lambda: dict(CATEGORY_PREFIXES))
    category_by_concept: dict[int, str] = field(
        default_factory=lambda: dict(CATEGORY_BY_CONCEPT)
    )
    unusable_category: str = UNUSABLE_CATEGORY
    lookback_days: int = 7
    age_cap: int = 90
    # A label is kept when at least this many persons carry it.  When
    # ``rare_fraction`` is set it replaces the absolute number.
    rare_min_persons: int = 1000
    rare_fraction: float | None = None
    holdout_fraction: float = 0.2
    split_seed: int = 123
    trials: int = 100
    trees: int = 180
    # Copies of a record in both parts normally count by their training copy.
    # Where it is known that copies never differ, saying so saves work.
    copies_agree: bool = False


DEFAULT_SETTINGS = CohortSettings()

# The stand-in tables use two small concept ids for the manual recodes and a
# relative rare-label threshold, so that one setting fits every scale factor.
STANDIN_SETTINGS = CohortSettings(
    category_by_concept={1: "MBD005", 2: "SYM013"},
    rare_fraction=0.10,
)
