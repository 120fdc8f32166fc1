"""Column expressions over claim and beneficiary fields (blank text means missing)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Standard concept ids.
GENDER = {"1": 8507, "2": 8532}
RACE = {"1": 8527, "2": 8516}
NOT_HISPANIC, HISPANIC = 38003564, 38003563

# SSA state code to postal abbreviation.
SSA_STATE = {
    "01": "AL", "02": "AK", "03": "AZ", "04": "AR", "05": "CA", "06": "CO", "07": "CT", "08": "DE",
    "09": "DC", "10": "FL", "11": "GA", "12": "HI", "13": "ID", "14": "IL", "15": "IN", "16": "IA",
    "17": "KS", "18": "KY", "19": "LA", "20": "ME", "21": "MD", "22": "MA", "23": "MI", "24": "MN",
    "25": "MS", "26": "MO", "27": "MT", "28": "NE", "29": "NV", "30": "NH", "31": "NJ", "32": "NM",
    "33": "NY", "34": "NC", "35": "ND", "36": "OH", "37": "OK", "38": "OR", "39": "PA", "41": "RI",
    "42": "SC", "43": "SD", "44": "TN", "45": "TX", "46": "UT", "47": "VT", "49": "VA", "50": "WA",
    "51": "WV", "52": "WI", "53": "WY", "54": "54",
}

# Concepts written for each feed. The carrier feed uses the outpatient positions.
FEED_CONCEPTS = {
    "inpatient": {
        "visit_concept_id": 9201, "visit_type_concept_id": 44818517,
        "condition_type_concept_id": 38000200, "procedure_type_concept_id": 38000251,
        "place_of_service_concept_id": 8717, "place_of_service_source_value": "Inpatient Facility",
    },
    "outpatient": {
        "visit_concept_id": 9202, "visit_type_concept_id": 44818517,
        "condition_type_concept_id": 38000230, "procedure_type_concept_id": 38000269,
        "place_of_service_concept_id": 8756, "place_of_service_source_value": "Outpatient Facility",
    },
    "carrier": {
        "visit_concept_id": 0, "visit_type_concept_id": 44818517,
        "condition_type_concept_id": 38000230, "procedure_type_concept_id": 38000269,
        "place_of_service_concept_id": 8940, "place_of_service_source_value": " ",
    },
}
# Concepts that do not depend on the feed.
DRUG_TYPE = 38000175
DEVICE_TYPE = 44818705
MEASUREMENT_TYPE = 45754907
OBSERVATION_TYPE = 38000282
OBSERVATION_PERIOD_TYPE = 44814722
DEATH_TYPE = 38003565
US_DOLLAR = 44818668


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def not_blank(c: Column) -> Column:
    """The value, or NULL when it is empty text."""
    return F.nullif(c, F.lit(""))


def parse_ymd(c: Column) -> Column:
    """``YYYYMMDD`` text to a date; blank stays missing, anything unreadable becomes missing."""
    return F.to_date(F.try_to_timestamp(not_blank(c), F.lit("yyyyMMdd")))


def parse_date(c: Column) -> Column:
    """A date written either as ``YYYYMMDD`` or as ``YYYY-MM-DD``."""
    return F.coalesce(parse_ymd(c), F.to_date(F.try_to_timestamp(not_blank(c), F.lit("yyyy-MM-dd"))))


def birth_parts(c: Column) -> dict[str, Column]:
    return {
        "year_of_birth": F.substring(c, 1, 4).try_cast("int"),
        "month_of_birth": F.substring(c, 5, 2).try_cast("int"),
        "day_of_birth": F.substring(c, 7, 2).try_cast("int"),
    }


def gender_concept(code: Column) -> Column:
    plain = code.try_cast("int").cast("string")
    return F.coalesce(literal_map(GENDER)[plain], F.lit(0))


def race_ethnicity(code: Column) -> Column:
    """Struct ``race, ethnicity`` of a race code; an unknown code gives 0 for both."""
    plain = code.try_cast("int").cast("string")
    ethnicity = F.when(plain.isin("1", "2", "3"), NOT_HISPANIC).when(plain == "5", HISPANIC).otherwise(0)
    return F.struct(F.coalesce(literal_map(RACE)[plain], F.lit(0)).alias("race"), ethnicity.alias("ethnicity"))


def ssa_state(code: Column) -> Column:
    """Postal abbreviation; a code that is not listed (as written, unpadded) is kept."""
    return F.coalesce(literal_map(SSA_STATE)[code], code)


def county_code(state: Column, county: Column) -> Column:
    """Two-digit state and three-digit county in one code; a blank part stays blank."""
    wide = F.when(F.length(county).between(1, 2), F.lpad(county, 3, "0")).otherwise(county)
    return F.concat(F.when(F.length(state) == 1, F.lpad(state, 2, "0")).otherwise(state), wide)


def location_key(state: Column, county: Column) -> Column:
    return F.concat_ws("-", state, county)


def code_list(cols: list[Column]) -> Column:
    """The codes that are filled in, in column order."""
    return F.filter(F.array(*cols), lambda x: x != "")


def tagged_codes(vocab: str, cols: list[Column]) -> Column:
    return F.transform(code_list(cols), lambda x: F.struct(F.lit(vocab).alias("vocab"), x.alias("code")))


def claim_provider(attending: Column, operating: Column, other: Column) -> Column:
    """The last of the three that is filled in."""
    return F.coalesce(not_blank(other), not_blank(operating), not_blank(attending))


def carrier_lines(groups: list[dict[str, Column]], key: str) -> Column:
    """Array of line structs, with their position, for the lines whose ``key`` field is filled in."""
    lines = [
        F.struct(F.lit(i).alias("line"), *[c.alias(name) for name, c in group.items()])
        for i, group in enumerate(groups, start=1)
    ]
    return F.filter(F.array(*lines), lambda line: line[key] != "")


def carrier_fact_provider_site(lines: Column, npi: str = "PRF_PHYSN_NPI", tax: str = "TAX_NUM") -> Column:
    """Struct ``npi, site`` of the last kept line; both missing when there is none."""
    last = F.get(lines, F.size(lines) - 1)
    return F.struct(not_blank(last[npi]).alias("npi"), not_blank(last[tax]).alias("site"))


AMOUNTS = (
    "LINE_NCH_PMT_AMT", "LINE_BENE_PTB_DDCTBL_AMT", "LINE_BENE_PRMRY_PYR_PD_AMT",
    "LINE_COINSRNC_AMT", "LINE_ALOWD_CHRG_AMT",
)


def has_nonzero_amount(line: Column) -> Column:
    """Any of the five amounts is filled in (``0.00`` counts)."""
    return F.concat(*[F.coalesce(line[a], F.lit("")) for a in AMOUNTS]) != ""


def out_of_pocket(line: Column) -> Column:
    """Deductible plus coinsurance; 0 when either cannot be read."""
    parts = [line[a].try_cast("decimal(18,4)") for a in ("LINE_BENE_PTB_DDCTBL_AMT", "LINE_COINSRNC_AMT")]
    return F.coalesce((parts[0] + parts[1]).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def type_concepts(feed: Column, name: str) -> Column:
    """The concept (or text) called ``name`` for a feed."""
    return literal_map({k: v[name] for k, v in FEED_CONCEPTS.items()})[feed]
