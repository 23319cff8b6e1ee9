"""Imports every module that registers queries."""

from . import q_answers, q_corpus, q_errors, q_evidence, q_facts, q_lanes, q_relational, q_resample, q_scoring, q_sequences, q_streams, q_text  # noqa: F401
