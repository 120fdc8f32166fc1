"""Vocabulary folding and routing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from medweave.functions.claims import literal_map

ICD9, HCPCS, NDC = "ICD9", "HCPCS", "NDC"
MAPPABLE = (ICD9, HCPCS, NDC)

# Vocabularies that are looked up under another name.
FOLDED = {"CPT4": HCPCS, "ICD9CM": ICD9, "ICD9Proc": ICD9}

# The table a concept of each domain is written to.
DESTINATION = {
    "Condition": "condition",
    "Condition/Meas": "measurement",
    "Condition/Obs": "observation",
    "Condition/Procedure": "procedure",
    "Device": "device",
    "Device/Obs": "observation",
    "Device/Procedure": "procedure",
    "Drug": "drug",
    "Measurement": "measurement",
    "Meas/Procedure": "procedure",
    "Obs/Procedure": "procedure",
    "Observation": "observation",
    "Procedure": "procedure",
    "Visit": "visit",
    "Place of Service": "visit",
    "Meas Value": "measurement",
}


def normalise_vocab(vocabulary: Column) -> Column:
    return F.coalesce(literal_map(FOLDED)[vocabulary], vocabulary)


def normalise_code(code: Column) -> Column:
    return F.replace(code, F.lit("."), F.lit(""))


def route_domain(domain: Column) -> Column:
    """Destination of a domain; NULL for a domain that has none."""
    return literal_map(DESTINATION)[domain]
