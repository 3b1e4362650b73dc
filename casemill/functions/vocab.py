"""Vocabularies of labelled causal cases, and small tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Levels, the labels each allows, difficulties, acceptance limits.
LEVELS = {"L1": "Association", "L2": "Intervention", "L3": "Counterfactual"}
LABELS = {"L1": ["YES", "NO", "AMBIGUOUS"], "L2": ["NO"], "L3": ["VALID", "INVALID", "CONDITIONAL"]}
L3_LABEL = {"YES": "VALID", "NO": "INVALID", "AMBIGUOUS": "CONDITIONAL"}
AMBIGUOUS_LABELS = ["AMBIGUOUS", "CONDITIONAL"]
DIFFICULTIES = ["Easy", "Medium", "Hard"]
LEAST_CASES, ACCEPT_SCORE, REVISE_SCORE, SCENARIO_CHARS = 170, 8, 6, 50

# Trap codes and names by level; the second level's codes belong to families.
L1_TRAPS = {
    "W1": "Selection Bias", "W2": "Survivorship Bias", "W3": "Healthy User Bias", "W4": "Regression to Mean", "W5": "Ecological Fallacy",
    "W6": "Base Rate Neglect", "W7": "Confounding", "W8": "Simpson's Paradox", "W9": "Reverse Causation", "W10": "Post Hoc Fallacy",
    "S1": "RCT", "S2": "Natural Experiment", "S3": "Lottery/Quasi-Random", "S4": "Controlled Ablation", "S5": "Mechanism + Dose",
    "S6": "Instrumental Variable", "S7": "Diff-in-Diff", "S8": "Regression Discontinuity", "A": "Ambiguous",
}
L2_TRAPS = {
    "T1": "Selection", "T2": "Survivorship", "T3": "Collider", "T4": "Immortal Time", "T5": "Regression", "T6": "Ecological",
    "T7": "Confounder", "T8": "Simpson's", "T9": "Conf-Med", "T10": "Reverse", "T11": "Feedback", "T12": "Temporal",
    "T13": "Measurement", "T14": "Recall", "T15": "Mechanism", "T16": "Goodhart", "T17": "Backfire",
}
L3_TRAPS = {
    "F1": "Deterministic", "F2": "Probabilistic", "F3": "Overdetermination", "F4": "Structural",
    "F5": "Temporal", "F6": "Epistemic", "F7": "Attribution", "F8": "Moral/Legal",
}
L2_FAMILIES = {"F1": ["T1", "T2", "T3", "T4"], "F2": ["T5", "T6"], "F3": ["T7", "T8", "T9"], "F4": ["T10", "T11", "T12"], "F5": ["T13", "T14"], "F6": ["T15", "T16", "T17"]}
L3_ANSWERS = {f: ["CONDITIONAL"] if f == "F6" else ["VALID", "INVALID"] if f == "F1" else ["VALID", "INVALID", "CONDITIONAL"] for f in L3_TRAPS}
AMBIGUITIES = ["Temporal Ambiguity", "Mechanism Ambiguity", "Structural Ambiguity", "Magnitude Ambiguity"]
UNLABELLED_TRAPS = {"L1": ["NONE"], "L2": [], "L3": ["NONE"]}

# Older trap names and the code of each, as exports know them.
L1_LEGACY = {
    "CONFOUNDING": "W7", "CONFOUNDER": "W7", "COLLIDER": "W7", "SELECTION": "W1", "SELECTION_BIAS": "W1", "SURVIVORSHIP": "W2", "SURVIVORSHIP_BIAS": "W2",
    "HEALTHY_USER": "W3", "HEALTHY_USER_BIAS": "W3", "REGRESSION": "W4", "REGRESSION_TO_MEAN": "W4", "ECOLOGICAL": "W5", "ECOLOGICAL_FALLACY": "W5",
    "BASE_RATE": "W6", "BASE_RATE_NEGLECT": "W6", "SIMPSONS": "W8", "SIMPSONS_PARADOX": "W8", "REVERSE": "W9", "REVERSE_CAUSATION": "W9",
    "POST_HOC": "W10", "POST_HOC_FALLACY": "W10", "RCT": "S1", "NATURAL_EXPERIMENT": "S2", "LOTTERY": "S3", "QUASI_RANDOM": "S3", "ABLATION": "S4",
    "CONTROLLED_ABLATION": "S4", "MECHANISM_DOSE": "S5", "DOSE_RESPONSE": "S5", "INSTRUMENTAL": "S6", "INSTRUMENTAL_VARIABLE": "S6",
    "DIFF_IN_DIFF": "S7", "REGRESSION_DISCONTINUITY": "S8", "AMBIGUOUS": "A",
}
L2_LEGACY = {
    "SELECTION": "T1", "SURVIVORSHIP": "T2", "COLLIDER": "T3", "IMMORTAL_TIME": "T4", "REGRESSION": "T5", "ECOLOGICAL": "T6", "CONFOUNDING": "T7",
    "CONFOUNDER": "T7", "SIMPSONS": "T8", "CONF_MED": "T9", "REVERSE": "T10", "FEEDBACK": "T11", "TEMPORAL": "T12", "MEASUREMENT": "T13",
    "RECALL": "T14", "MECHANISM": "T15", "GOODHART": "T16", "BACKFIRE": "T17", "AMBIG_MECHANISM": "T15", "AMBIG_TIMING": "T12",
    "AMBIG_MAGNITUDE": "T5", "AMBIG_STRUCTURE": "T7",
}
L3_LEGACY = {
    "DETERMINISTIC": "F1", "PROBABILISTIC": "F2", "OVERDETERMINATION": "F3", "STRUCTURAL": "F4", "TEMPORAL": "F5", "EPISTEMIC": "F6",
    "ATTRIBUTION": "F7", "MORAL_LEGAL": "F8", "MORAL": "F8", "LEGAL": "F8",
}

# The older names that imports know, for all levels, and for the second level before those; its default.
IMPORTED_TRAPS = {
    "CONFOUNDING": "W7", "SELECTION": "W1", "SELECTION_BIAS": "W1", "SURVIVORSHIP": "W2", "SURVIVORSHIP_BIAS": "W2", "HEALTHY_USER": "W3",
    "HEALTHY_USER_BIAS": "W3", "REGRESSION": "W4", "REGRESSION_TO_MEAN": "W4", "ECOLOGICAL": "W5", "ECOLOGICAL_FALLACY": "W5", "BASE_RATE": "W6",
    "BASE_RATE_NEGLECT": "W6", "SIMPSONS": "W8", "SIMPSONS_PARADOX": "W8", "REVERSE": "W9", "REVERSE_CAUSATION": "W9", "POST_HOC": "W10",
    "POST_HOC_FALLACY": "W10", "COLLIDER": "W7", "NONE": "S1",
}
IMPORTED_L2_TRAPS = {
    "CONFOUNDING": "T7", "CONFOUNDER": "T7", "SELECTION": "T1", "SURVIVORSHIP": "T2", "COLLIDER": "T3", "IMMORTAL_TIME": "T4", "REGRESSION": "T5",
    "ECOLOGICAL": "T6", "SIMPSONS": "T8", "CONF_MED": "T9", "REVERSE": "T10", "FEEDBACK": "T11", "TEMPORAL": "T12", "MEASUREMENT": "T13",
    "RECALL": "T14", "MECHANISM": "T15", "GOODHART": "T16", "BACKFIRE": "T17",
}
L2_DEFAULT_TRAP = "T7"

# Phrases that show a scenario states its structural assumptions.
STRUCTURAL_PHRASES = ["assume", "assuming", "given that", "suppose", "only factor", "only cause", "sole cause", "only mechanism", "simulation", "model shows", "parallel", "experiment", "rct", "randomized", "controlled trial"]

# Greatest score of each rubric part, and whether only ambiguous cases are scored on it.
RUBRIC = [("scenarioClarityScore", 1.0, False), ("hiddenQuestionScore", 1.0, True), ("conditionalAnswerAScore", 1.5, True), ("conditionalAnswerBScore", 1.5, True), ("wiseRefusalScore", 2.0, False), ("difficultyCalibrationScore", 1.0, False), ("finalLabelScore", 1.0, False), ("trapTypeScore", 1.0, False)]

REQUIRED_FIELDS = ["id", "case_id", "bucket", "pearl_level", "domain", "scenario", "claim", "label", "is_ambiguous", "variables", "trap", "difficulty", "initial_author", "validator", "final_score"]

#: Struct of an exported case.
CASE_SCHEMA = (
    "id string, case_id string, bucket string, pearl_level string, domain string, subdomain string, scenario string, claim string, label string, "
    "is_ambiguous boolean, variables struct<X:struct<name:string,role:string>,Y:struct<name:string,role:string>,Z:array<string>,`X'`:string>, "
    "trap struct<type:string,type_name:string,subtype:string,subtype_name:string>, difficulty string, causal_structure string, key_insight string, "
    "hidden_timestamp string, conditional_answers struct<answer_if_condition_1:string,answer_if_condition_2:string>, wise_refusal string, "
    "gold_rationale string, initial_author string, validator string, final_score double"
)


def traps(spark: SparkSession) -> DataFrame:
    """level, code, name, family: the trap taxonomy, a few dozen rows."""
    family = {t: f for f, own in L2_FAMILIES.items() for t in own}
    rows = [(level, code, name, family.get(code) if level == "L2" else code if level == "L3" else "sheep" if code[0] == "S" else "wolf" if code[0] == "W" else None) for level, own in (("L1", L1_TRAPS), ("L2", L2_TRAPS), ("L3", L3_TRAPS)) for code, name in own.items()]
    return spark.createDataFrame(rows, "level string, code string, name string, family string")


def legacy_traps(spark: SparkSession) -> DataFrame:
    """level, key, code: older names that exports know, and the codes themselves, by level."""
    rows = [(level, key, code) for level, own, codes in (("L1", L1_LEGACY, L1_TRAPS), ("L2", L2_LEGACY, L2_TRAPS), ("L3", L3_LEGACY, L3_TRAPS)) for key, code in [*own.items(), *((c, c) for c in codes)]]
    return spark.createDataFrame(rows, "level string, key string, code string")
