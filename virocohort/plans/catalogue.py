"""Imports every query module so that the registry is complete."""

from virocohort.plans import q_evaluation, q_evidence, q_families, q_fusion, q_intervals, q_orf, q_quality, q_scans, q_sequence  # noqa: F401
from virocohort.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "fu12_functional_classification"
