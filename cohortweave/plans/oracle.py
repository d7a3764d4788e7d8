"""Independent DuckDB SQL for every SQL-expressible query of the catalog.

``_VIEWS`` are named building blocks in dependency order; each query gets
exactly the ones it needs as common table expressions.  The blocks state the
step-by-step definition of each result (dedup, fan-out, window, cascade), not
the fused form the Spark plans use.
"""

from __future__ import annotations

import re

from cohortweave.settings import (
    CATEGORY_PREFIXES,
    COMORBIDITY_CODESETS,
    DRUG_CODESETS,
    ECMO_CODESET,
    ETHNICITY_GROUPS,
    GENDER_GROUPS,
    RACE_GROUPS,
    STANDIN_SETTINGS,
    UNUSABLE_CATEGORY,
    VENTILATION_CODESET,
)
from cohortweave.sources.standin import STANDIN_CODESETS

# Labels that at least 10 % of the persons carry at scale factor 0.01, the
# scale at which the comparison runs; they are column names of the results.
KEPT_LABELS = [
    "post_CIR003", "post_CIR004", "post_CIR005", "post_CIR007",
    "pre_CIR000", "pre_CIR003", "pre_CIR004", "pre_CIR005", "pre_CIR006",
    "pre_CIR007", "pre_CIR008", "pre_CIR009", "pre_PRG",
]


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _group_case(column: str, groups: dict, extra: str = "") -> str:
    rules = " ".join(
        f"WHEN {column} IN ({_quoted(members)}) THEN '{name}'" for name, members in groups.items()
    )
    return f"replace(CASE {rules} {extra} ELSE {column} END, ' ', '_')"


_MEDS = [n for n in DRUG_CODESETS.values() if n != STANDIN_SETTINGS.vaccine_flag]
_RECODE = (
    "CASE "
    + " ".join(
        f"WHEN starts_with(default_ccsr_category_op_clean, '{p}') THEN '{v}'"
        for p, v in CATEGORY_PREFIXES.items()
    )
    + " "
    + " ".join(
        f"WHEN condition_concept_id = {c} THEN '{v}'"
        for c, v in STANDIN_SETTINGS.category_by_concept.items()
    )
    + " ELSE default_ccsr_category_op_clean END"
)
_FLAGS = ", ".join(
    f"CAST(drug_concept_id IN (SELECT concept_id FROM fx_codeset WHERE codeset_id = {c}) AS INT)"
    f" AS {n}"
    for c, n in DRUG_CODESETS.items()
)
_LABEL_COLUMNS = ", ".join(
    f"CAST(max(CASE WHEN pre_post_condition = '{v}' THEN 1 ELSE 0 END) AS INT) AS \"{v}\""
    for v in KEPT_LABELS
)
_CODESET_ROWS = ", ".join(str(row) for row in STANDIN_CODESETS)

_VIEWS: dict[str, str] = {
    # ---- stand-in tables ----
    "fx_person": """
        SELECT c_custkey AS person_id,
          CASE WHEN c_custkey % 50 = 0 THEN NULL
               ELSE CAST(1910 + (c_custkey * 7) % 80 AS INT) END AS year_of_birth,
          CAST(1 + c_custkey % 12 AS INT) AS month_of_birth,
          c_custkey % 97 = 0 AS is_age_90_or_older,
          CASE c_custkey % 9 WHEN 0 THEN 'Black' WHEN 1 THEN 'Black or African American'
            WHEN 2 THEN 'Multiple races' WHEN 3 THEN 'Asian Indian' WHEN 4 THEN 'Asian'
            WHEN 5 THEN 'No information' WHEN 7 THEN 'White'
            WHEN 8 THEN 'Native Hawaiian or Other Pacific Islander' END AS race_concept_name,
          CASE c_nationkey % 4 WHEN 0 THEN 'Not Hispanic or Latino'
            WHEN 1 THEN 'Hispanic or Latino' WHEN 2 THEN 'No matching concept' END
            AS ethnicity_concept_name,
          CASE WHEN c_custkey % 40 = 0 THEN 'UNKNOWN' WHEN c_custkey % 2 = 0 THEN 'MALE'
            ELSE 'FEMALE' END AS gender_concept_name
        FROM customer""",
    "fx_person_test": "SELECT * FROM fx_person WHERE person_id % 5 = 0",
    "fx_person_train": "SELECT * FROM fx_person WHERE person_id % 5 <> 0 OR person_id % 10 = 0",
    "fx_outcome_train": """
        SELECT c_custkey AS person_id,
          DATE '1998-01-01' + CAST((c_custkey * 37) % 700 AS INT) AS covid_index,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS pasc_code_after_four_weeks,
          CASE WHEN c_custkey % 33 = 1 THEN 1 ELSE 0 END AS pasc_code_prior_four_weeks
        FROM customer WHERE c_custkey % 5 <> 0""",
    "fx_outcome_test": """
        SELECT c_custkey AS person_id,
          DATE '1998-01-01' + CAST((c_custkey * 37) % 700 AS INT) AS covid_index
        FROM customer WHERE c_custkey % 5 = 0""",
    "fx_concept": """
        SELECT p_partkey AS concept_id, p_name || ' ' || p_brand AS concept_name,
          'A' || lpad(CAST(p_size AS VARCHAR), 2, '0')
            || CASE WHEN p_partkey % 2 = 0 THEN '.' || CAST(p_partkey % 10 AS VARCHAR)
               ELSE '' END AS concept_code,
          CASE WHEN p_type = 'PROMO' THEN 'Drug' ELSE 'Condition' END AS domain_id,
          CASE WHEN p_partkey % 3 = 0 THEN 'ICD10CM' ELSE 'SNOMED' END AS vocabulary_id,
          CASE WHEN p_partkey % 41 = 0 THEN 'D' END AS invalid_reason
        FROM part""",
    "fx_concept_relationship": """
        SELECT p_partkey AS concept_id_1, p_partkey + 1 AS concept_id_2,
               'Maps to' AS relationship_id FROM part
        UNION ALL SELECT p_partkey, p_partkey + 4, 'Maps to' FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey, p_partkey, 'Maps to' FROM part
        UNION ALL SELECT p_partkey + 1, p_partkey, 'Mapped from' FROM part""",
    "fx_dxccsr": """
        SELECT DISTINCT '''' || 'A' || lpad(CAST(p_size AS VARCHAR), 2, '0')
            || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 10 AS VARCHAR) ELSE '' END
            || '''' AS "ICD-10-CM_CODE",
          '''' || CASE WHEN p_size % 10 = 1 THEN 'PRG' || lpad(CAST(p_size AS VARCHAR), 3, '0')
            WHEN p_size % 10 = 2 THEN 'XXX111' ELSE 'CIR00' || CAST(p_size % 10 AS VARCHAR) END
            || '''' AS Default_CCSR_CATEGORY_OP
        FROM part WHERE p_size <= 45
        UNION ALL SELECT '''Z99''', '''FAC001'''""",
    "fx_codeset": f"""
        SELECT s.codeset_id, s.concept_set_name, p_partkey AS concept_id
        FROM part JOIN (VALUES {_CODESET_ROWS}) AS s(codeset_id, concept_set_name, m, r)
          ON p_partkey % s.m = s.r""",
    "fx_line": """
        SELECT l_orderkey * 10 + l_linenumber AS id, MIN(o_custkey) AS person_id,
          MIN(l_partkey) AS concept_id, CAST(MIN(l_shipdate) AS DATE) AS event_date,
          MIN(l_returnflag) AS flag, MIN(l_suppkey) % 3 AS kind
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey * 10 + l_linenumber""",
    "fx_condition_era": """
        SELECT id AS condition_era_id, person_id, concept_id AS condition_concept_id,
          event_date AS condition_era_start_date
        FROM fx_line WHERE flag = 'A' AND person_id % 20 <> 3""",
    "fx_drug_era": """
        SELECT id AS drug_era_id, person_id, concept_id AS drug_concept_id,
          event_date AS drug_era_start_date
        FROM fx_line WHERE flag = 'R' OR id % 4 = 0""",
    "fx_visit": """
        SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
          CAST(o_orderdate AS DATE) AS visit_start_date,
          CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS visit_end_date,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - 2 END
            AS macrovisit_start_date,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 30 END
            AS macrovisit_end_date,
          CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 'Inpatient Visit'
            WHEN o_orderpriority = '2-HIGH' THEN 'Emergency Room Visit'
            WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Outpatient Visit' END
            AS visit_concept_name
        FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 <> 0""",
    # ---- stacking and demographics ----
    "v_person": "SELECT * FROM fx_person_train UNION SELECT * FROM fx_person_test",
    "v_outcome": """
        SELECT * FROM fx_outcome_train UNION ALL
        SELECT person_id, covid_index, CAST(NULL AS INT), CAST(NULL AS INT)
        FROM fx_outcome_test""",
    "v_person_outcome": "SELECT * FROM v_person JOIN v_outcome USING (person_id)",
    "v_index": "SELECT person_id, covid_index FROM v_person_outcome",
    "v_age": """
        SELECT *, make_date(year_of_birth, month_of_birth, 1) AS date_of_birth,
          CASE WHEN is_age_90_or_older THEN 90.0::DOUBLE ELSE
            round((covid_index - make_date(year_of_birth, month_of_birth, 1))
                  / 365.25::DOUBLE) END AS age_at_covid
        FROM v_person_outcome""",
    "v_person_all": f"""
        SELECT *,
          coalesce(age_at_covid, (SELECT quantile_disc(age_at_covid, 0.5) FROM v_age))
            AS age_at_covid_imputed,
          {_group_case("race_concept_name", RACE_GROUPS,
                       "WHEN race_concept_name IS NULL THEN 'Unknown'")} AS race_cats,
          {_group_case("ethnicity_concept_name", ETHNICITY_GROUPS)} AS ethnicity_cats,
          {_group_case("gender_concept_name", GENDER_GROUPS)} AS gender_cats
        FROM v_age""",
    # ---- vocabulary and eras ----
    "v_maps_to": """
        SELECT * FROM fx_concept_relationship
        WHERE relationship_id = 'Maps to' AND concept_id_1 <> concept_id_2""",
    "v_source": """
        SELECT *, replace(concept_code, '.', '') AS concept_code_clean FROM fx_concept
        WHERE domain_id = 'Condition' AND vocabulary_id = 'ICD10CM'
          AND invalid_reason IS NULL""",
    "v_grouper": """
        SELECT *, replace("ICD-10-CM_CODE", '''', '') AS icd10cm_clean,
          replace(Default_CCSR_CATEGORY_OP, '''', '') AS default_ccsr_category_op_clean
        FROM fx_dxccsr""",
    "v_mapped": """
        SELECT m.*, g.* FROM (
          SELECT c.concept_id, c.concept_name, c.concept_code_clean, r.concept_id_1,
                 r.concept_id_2
          FROM v_maps_to r JOIN v_source c ON c.concept_id = r.concept_id_1) m
        FULL OUTER JOIN v_grouper g ON m.concept_code_clean = g.icd10cm_clean""",
    "v_condition_mapped": """
        SELECT e.*, m.* FROM fx_condition_era e
        LEFT JOIN v_mapped m ON e.condition_concept_id = m.concept_id_2""",
    "v_recoded": f"""
        SELECT condition_era_id, person_id, condition_concept_id, condition_era_start_date,
          icd10cm_clean, {_RECODE} AS default_ccsr_category_op_clean
        FROM v_condition_mapped""",
    "v_usable": f"""
        SELECT * FROM v_recoded WHERE default_ccsr_category_op_clean IS NOT NULL
          AND default_ccsr_category_op_clean <> '{UNUSABLE_CATEGORY}'""",
    "v_icd": """
        SELECT person_id, condition_era_id, condition_era_start_date, icd10cm_clean,
          default_ccsr_category_op_clean, condition_concept_id,
          concept_name AS condition_concept_name,
          CAST(length(icd10cm_clean) AS INT) AS icd_length
        FROM v_usable LEFT JOIN fx_concept ON condition_concept_id = concept_id
        QUALIFY row_number() OVER (PARTITION BY condition_era_id
          ORDER BY length(icd10cm_clean) NULLS FIRST, icd10cm_clean NULLS FIRST,
                   default_ccsr_category_op_clean, condition_concept_id) = 1""",
    # ---- severity ----
    "v_event": """
        SELECT CASE kind WHEN 0 THEN 'procedure' WHEN 1 THEN 'observation'
                 ELSE 'condition' END AS source,
          id AS event_id, l.person_id, l.concept_id, l.event_date, i.covid_index
        FROM fx_line l JOIN v_index i ON l.person_id = i.person_id
        WHERE event_date >= covid_index - 7""",
    "v_vent": f"""
        SELECT * FROM v_event WHERE concept_id IN
          (SELECT concept_id FROM fx_codeset WHERE codeset_id = {VENTILATION_CODESET})""",
    "v_ecmo": f"""
        SELECT * FROM v_event WHERE source <> 'condition' AND concept_id IN
          (SELECT concept_id FROM fx_codeset WHERE codeset_id = {ECMO_CODESET})""",
    "v_hits": """
        SELECT 'ventilation' AS codeset, * FROM v_vent UNION ALL SELECT 'ecmo', * FROM v_ecmo""",
    "v_severe": """
        SELECT person_id, 'Severe' AS who_severity FROM v_vent
        UNION SELECT person_id, 'Severe' FROM v_ecmo""",
    "v_qualifying": """
        SELECT v.*, i.covid_index FROM fx_visit v JOIN v_index i ON v.person_id = i.person_id
        WHERE visit_start_date >= covid_index - 7
          OR covid_index BETWEEN visit_start_date AND visit_end_date
          OR covid_index BETWEEN macrovisit_start_date AND macrovisit_end_date""",
    "v_left": """
        SELECT * FROM v_qualifying WHERE person_id NOT IN (SELECT person_id FROM v_severe)""",
    "v_names": """
        SELECT person_id, coalesce(
            string_agg(visit_concept_name, ', ' ORDER BY visit_concept_name), '') AS names
        FROM v_left GROUP BY person_id""",
    "v_visit_severity": """
        SELECT person_id, CASE WHEN contains(names, 'Inpatient') THEN 'Moderate' ELSE 'Mild' END
          AS who_severity FROM v_names""",
    "v_no_visit": """
        SELECT person_id FROM v_index WHERE person_id NOT IN (SELECT person_id FROM v_severe)
          AND person_id NOT IN (SELECT person_id FROM v_visit_severity)""",
    "v_severity": """
        SELECT * FROM v_severe UNION ALL SELECT * FROM v_visit_severity
        UNION ALL SELECT person_id, 'Mild' FROM v_no_visit""",
    # ---- medications ----
    "v_flags": f"SELECT *, {_FLAGS} FROM fx_drug_era",
    "v_vaccine": """
        SELECT f.*, i.covid_index,
          CASE WHEN covid_vaccine = 1 AND drug_era_start_date < covid_index THEN 1 ELSE 0 END
            AS pre_covid_vaccine,
          CASE WHEN covid_vaccine = 1 AND drug_era_start_date >= covid_index THEN 1 ELSE 0 END
            AS post_covid_vaccine
        FROM v_flags f LEFT JOIN v_index i ON f.person_id = i.person_id""",
    "v_drug_sums": "SELECT person_id, "
    + ", ".join(
        f"CAST(sum({n}) AS BIGINT) AS {n}_sum"
        for n in [*_MEDS, "pre_covid_vaccine", "post_covid_vaccine"]
    )
    + " FROM v_vaccine GROUP BY person_id",
    "v_meds": f"""
        SELECT person_id, pre_covid_vaccine_sum, post_covid_vaccine_sum,
          CASE WHEN {" + ".join(f"{n}_sum" for n in _MEDS)} > 0 THEN 1 ELSE 0 END AS med_sum
        FROM v_drug_sums""",
    # ---- comorbidity, labels, pivot ----
    "v_comorbidity": f"""
        SELECT person_id, count(DISTINCT concept_set_name) AS cci_count
        FROM v_icd JOIN fx_codeset ON condition_concept_id = concept_id
        WHERE codeset_id IN ({", ".join(map(str, COMORBIDITY_CODESETS))})
        GROUP BY person_id""",
    "v_pre_post": """
        SELECT e.*, i.covid_index,
          CASE WHEN condition_era_start_date < covid_index THEN 'pre' ELSE 'post' END
            AS pre_post_covid,
          CASE WHEN condition_era_start_date < covid_index THEN 'pre' ELSE 'post' END
            || '_' || default_ccsr_category_op_clean AS pre_post_condition
        FROM v_icd e LEFT JOIN v_index i ON e.person_id = i.person_id""",
    "v_cci": """
        SELECT p.*, coalesce(c.cci_count, 0) AS cci_count
        FROM v_pre_post p LEFT JOIN v_comorbidity c ON p.person_id = c.person_id""",
    "v_frequency": """
        SELECT pre_post_condition AS condition, count(DISTINCT person_id) AS condition_count
        FROM v_cci GROUP BY pre_post_condition""",
    "v_kept": """
        SELECT condition FROM v_frequency
        WHERE condition_count >= (SELECT count(*) FROM v_index) * 0.10""",
    "v_kept_rows": """
        SELECT * FROM v_cci WHERE pre_post_condition IN (SELECT condition FROM v_kept)""",
    "v_pivot": f"SELECT person_id, {_LABEL_COLUMNS} FROM v_kept_rows GROUP BY person_id",
    "v_conditions": """
        SELECT c.person_id, p.* EXCLUDE (person_id), c.cci_count
        FROM v_pivot p RIGHT JOIN (SELECT DISTINCT person_id, cci_count FROM v_cci) c
          ON p.person_id = c.person_id""",
    # ---- cohort and model matrix ----
    "v_cohort": "SELECT p.person_id, p.pasc_code_after_four_weeks, p.pasc_code_prior_four_weeks,"
    " p.age_at_covid_imputed, p.gender_cats, p.race_cats, p.ethnicity_cats, "
    + ", ".join(f'coalesce(c."{v}", 0) AS "{v}"' for v in KEPT_LABELS)
    + """, coalesce(c.cci_count, 0) AS cci_count,
          coalesce(m.pre_covid_vaccine_sum, 0) AS pre_covid_vaccine_sum,
          coalesce(m.post_covid_vaccine_sum, 0) AS post_covid_vaccine_sum,
          coalesce(m.med_sum, 0) AS med_sum, s.who_severity
        FROM v_person_all p LEFT JOIN v_conditions c ON p.person_id = c.person_id
          LEFT JOIN v_meds m ON p.person_id = m.person_id
          LEFT JOIN v_severity s ON p.person_id = s.person_id""",
    "v_eligible": """
        SELECT * FROM v_cohort
        WHERE pasc_code_prior_four_weeks = 0 OR pasc_code_after_four_weeks IS NULL""",
    "v_matrix": """
        SELECT * EXCLUDE (pasc_code_prior_four_weeks, race_cats, ethnicity_cats, who_severity,
                          gender_cats),
          CASE WHEN who_severity = 'Moderate' THEN 1 ELSE 0 END AS "who_severity_Moderate",
          CASE WHEN who_severity = 'Severe' THEN 1 ELSE 0 END AS "who_severity_Severe",
          CASE WHEN gender_cats = 'MALE' THEN 1 ELSE 0 END AS "gender_cats_MALE"
        FROM v_eligible""",
    "v_labelled": """
        SELECT person_id, pasc_code_after_four_weeks FROM v_person_all
        WHERE pasc_code_after_four_weeks IS NOT NULL""",
    "v_confusion": """
        SELECT count(*) FILTER (toxic = 0 AND quality = 0) AS tn,
          count(*) FILTER (toxic = 0 AND quality = 1) AS fp,
          count(*) FILTER (toxic = 1 AND quality = 0) AS fn,
          count(*) FILTER (toxic = 1 AND quality = 1) AS tp
        FROM labels""",
    "v_scored": """
        SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id)
        WHERE toxic IN (0, 1) AND n_chars IS NOT NULL""",
}

_FINAL: dict[str, str] = {
    "scan_typed": "SELECT doc_id, quality, toxic FROM labels",
    "csv_round_trip": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
          CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders""",
    "stack_splits_persons": "SELECT * FROM v_person",
    "stack_outcomes_missing_cols": "SELECT * FROM v_outcome",
    "enrich_concept_name": """
        SELECT e.*, c.concept_name AS condition_concept_name FROM fx_condition_era e
        LEFT JOIN fx_concept c ON e.condition_concept_id = c.concept_id""",
    "codeset_filter": f"""
        SELECT * FROM fx_codeset
        WHERE codeset_id IN ({", ".join(map(str, COMORBIDITY_CODESETS))})""",
    "maps_to_non_self": "SELECT * FROM v_maps_to",
    "clean_source_codes": "SELECT * FROM v_source",
    "clean_grouper_codes": "SELECT * FROM v_grouper",
    "mapped_concepts": "SELECT * FROM v_mapped",
    "condition_mapped": "SELECT * FROM v_condition_mapped",
    "recode_category": "SELECT * FROM v_recoded",
    "drop_unusable_category": "SELECT * FROM v_usable",
    "era_category_distinct": """
        SELECT condition_era_id, default_ccsr_category_op_clean,
          CAST(length(icd10cm_clean) AS INT) AS icd_length, icd10cm_clean, person_id,
          condition_concept_id, condition_era_start_date
        FROM v_usable
        QUALIFY row_number() OVER (
          PARTITION BY condition_era_id, default_ccsr_category_op_clean
          ORDER BY length(icd10cm_clean) NULLS FIRST, icd10cm_clean NULLS FIRST) = 1""",
    "icd_match": "SELECT * FROM v_icd",
    "person_outcome": "SELECT * FROM v_person_outcome",
    "age_at_index": "SELECT person_id, date_of_birth, age_at_covid FROM v_age",
    "age_without_cap_flag": """
        SELECT person_id, date_of_birth,
          round((covid_index - date_of_birth) / 365.25::DOUBLE) AS age_at_covid FROM v_age""",
    "impute_age_median": "SELECT person_id, age_at_covid, age_at_covid_imputed FROM v_person_all",
    "race_group": "SELECT person_id, race_concept_name, race_cats FROM v_person_all",
    "ethnicity_group": "SELECT person_id, ethnicity_concept_name, ethnicity_cats FROM v_person_all",
    "gender_group": "SELECT person_id, gender_concept_name, gender_cats FROM v_person_all",
    "race_counts": "SELECT race_cats, count(*) AS n_rows FROM v_person_all GROUP BY race_cats",
    "person_all": "SELECT * FROM v_person_all",
    "events_since_index": "SELECT * FROM v_event",
    "vent_events": "SELECT * FROM v_vent",
    "ecmo_events": "SELECT * FROM v_ecmo",
    "codeset_usage": """
        SELECT codeset, source, concept_name, count(*) AS n_rows FROM v_hits
        LEFT JOIN fx_concept USING (concept_id) GROUP BY codeset, source, concept_name""",
    "codeset_persons": """
        SELECT codeset, source, count(DISTINCT person_id) AS n_persons FROM v_hits
        GROUP BY codeset, source
        UNION ALL SELECT codeset, 'all', count(DISTINCT person_id) FROM v_hits
        GROUP BY codeset""",
    "severe_persons": "SELECT * FROM v_severe",
    "visits_not_severe": """
        SELECT * FROM fx_visit WHERE person_id NOT IN (SELECT person_id FROM v_severe)""",
    "qualifying_visits": "SELECT * FROM v_qualifying",
    "visit_severity": "SELECT * FROM v_visit_severity",
    "visit_name_list": """
        SELECT person_id, visit_concept_name, count(*) AS n_visits FROM v_left
        GROUP BY person_id, visit_concept_name
        HAVING visit_concept_name IS NOT NULL OR person_id NOT IN
          (SELECT person_id FROM v_left WHERE visit_concept_name IS NOT NULL)""",
    "visit_name_text": """
        SELECT person_id, place // 1000 AS segment,
          string_agg(visit_concept_name, ', ' ORDER BY place) AS concat_visit_concept_name
        FROM (SELECT person_id, visit_concept_name,
            row_number() OVER (PARTITION BY person_id ORDER BY visit_concept_name) - 1 AS place
          FROM v_left WHERE visit_concept_name IS NOT NULL)
        GROUP BY person_id, segment
        UNION ALL SELECT person_id, 0, '' FROM v_left GROUP BY person_id
        HAVING count(visit_concept_name) = 0""",
    "no_visit_persons": "SELECT * FROM v_no_visit",
    "covid_severity": "SELECT * FROM v_severity",
    "codeset_flags": "SELECT * FROM v_flags",
    "drug_usage": " UNION ALL ".join(
        f"SELECT '{n}' AS flag, count(*) FILTER ({n} = 0) AS eras_without,"
        f" count(*) FILTER ({n} = 1) AS eras_with,"
        f" count(DISTINCT CASE WHEN {n} = 1 THEN person_id END) AS persons_with FROM v_flags"
        for n in DRUG_CODESETS.values()
    ),
    "vaccine_pre_post": """
        SELECT drug_era_id, person_id, covid_index, pre_covid_vaccine, post_covid_vaccine
        FROM v_vaccine""",
    "drug_sums": "SELECT * FROM v_drug_sums",
    "medications_vaccinations": "SELECT * FROM v_meds",
    "comorbidity_count": "SELECT * FROM v_comorbidity",
    "pre_post_condition": "SELECT * FROM v_pre_post",
    "cci_count": "SELECT * FROM v_cci",
    "label_frequency": "SELECT * FROM v_frequency",
    "label_frequency_unpivot": "SELECT * FROM v_frequency",
    "kept_labels": "SELECT * FROM v_frequency WHERE condition IN (SELECT condition FROM v_kept)",
    "drop_rare_labels": "SELECT condition_era_id, person_id, pre_post_condition FROM v_kept_rows",
    "binary_pivot": "SELECT * FROM v_pivot",
    "conditions_only": "SELECT * FROM v_conditions",
    "cohort_features": "SELECT * FROM v_cohort",
    "exclude_early_outcome": "SELECT * FROM v_eligible",
    "model_matrix": "SELECT * FROM v_matrix",
    "train_rows": """
        SELECT * FROM v_matrix WHERE person_id NOT IN (SELECT person_id FROM fx_person_test)""",
    "test_rows": """
        SELECT * FROM v_matrix WHERE person_id IN (SELECT person_id FROM fx_person_test)""",
    "labelled_rows": "SELECT * FROM v_matrix WHERE pasc_code_after_four_weeks IS NOT NULL",
    "stratified_split": """
        SELECT person_id, pasc_code_after_four_weeks,
          row_number() OVER (PARTITION BY pasc_code_after_four_weeks
            ORDER BY md5('123:' || CAST(person_id AS VARCHAR)), person_id) * 5
          <= count(*) OVER (PARTITION BY pasc_code_after_four_weeks) AS is_holdout
        FROM v_labelled""",
    "class_weights": """
        SELECT *, CASE WHEN pasc_code_after_four_weeks = 1 THEN 4.0::DOUBLE
                  ELSE 1.0::DOUBLE END AS class_weight FROM v_labelled""",
    "confusion_matrix": "SELECT * FROM v_confusion",
    "binary_metrics": """
        SELECT CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
          CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1,
          CAST(tp AS DOUBLE) / (tp + fp) AS "precision",
          CAST(tp AS DOUBLE) / (tp + fn) AS recall,
          (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 AS auc_hard
        FROM v_confusion""",
    "rank_auc": """
        SELECT (SELECT CAST(sum(CASE WHEN p.n_chars > n.n_chars THEN 2
                                     WHEN p.n_chars = n.n_chars THEN 1 ELSE 0 END) AS DOUBLE)
                FROM v_scored p, v_scored n WHERE p.toxic = 1 AND n.toxic = 0)
            / (2 * CAST(count(*) FILTER (toxic = 1) AS DOUBLE)
                 * CAST(count(*) FILTER (toxic = 0) AS DOUBLE)) AS auc,
          count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives
        FROM v_scored""",
}


def _with_views(sql: str) -> str:
    """Prefix the common table expressions that ``sql`` needs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(_VIEWS[name])

    visit(sql)
    views = ", ".join(f"{name} AS ({_VIEWS[name]})" for name in _VIEWS if name in needed)
    return f"WITH {views} {sql}" if views else sql


def all_oracles() -> dict[str, str]:
    return {key: _with_views(sql) for key, sql in _FINAL.items()}
