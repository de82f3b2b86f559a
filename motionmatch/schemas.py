"""Column lists and explicit read schemas. Nothing is ever inferred."""

from __future__ import annotations

MANIFEST_COLUMNS = (
    "sample_id", "target_word", "performed_word", "signer_id", "source", "split",
    "sample_type", "expected_pass", "variant_status", "video_path", "keypoints_path",
    "anomaly_type", "source_sample_id",
)
MANIFEST_REQUIRED = (
    "sample_id", "target_word", "signer_id", "source", "split", "sample_type",
    "variant_status", "video_path", "source_sample_id",
)
MANIFEST_SCHEMA = ", ".join(f"{c} STRING" for c in MANIFEST_COLUMNS)

KEYPOINT_COLUMNS = ("frame", "landmark_index", "x", "y", "z")

SAMPLE_TYPES = ("positive", "hard_negative", "random_negative", "invalid")
SEMANTIC_TYPES = SAMPLE_TYPES[:3]
VARIANT_STATUSES = ("target_variant", "valid_alternate", "different_sign", "unreviewed")
# The label each reviewed variant must carry; unreviewed carries none.
LABEL_OF_VARIANT = {"target_variant": "true", "valid_alternate": "true",
                    "different_sign": "false", "unreviewed": ""}

FEATURES = (
    "target_similarity", "best_other_similarity", "similarity_margin", "hand_visibility",
    "motion_energy", "motion_span", "sequence_completeness", "start_position_difference",
    "end_position_difference",
)
MEASUREMENTS = FEATURES[3:]
TIMINGS = ("prepare_ms", "quality_ms", "similarity_ms", "reference_search_ms", "scoring_ms",
           "total_ms", "latency_ms")
RESULT_IDENTITY = (
    "sample_id", "target_word", "performed_word", "signer_id", "source", "split", "sample_type",
    "expected_pass", "variant_status", "source_sample_id", "anomaly_type", "repeat_index",
    "quality_valid",
)
RESULT_COLUMNS = (
    *RESULT_IDENTITY, "quality_reasons", "decision", "accepted", "score", "nearest_confusion",
    *FEATURES, "trajectory_distance", *TIMINGS,
)
CALIBRATION_COLUMNS = (*RESULT_IDENTITY, *FEATURES, "score", "accepted")

# Landmark layout of one frame: left hand, right hand, pose, lips.
LEFT_HAND, RIGHT_HAND, POSE = 21, 21, 33
# Face-mesh indices of the lip contour.
LIP_LANDMARKS = (
    61, 185, 40, 39, 37, 0, 267, 269, 270, 409, 291, 146, 91, 181, 84, 17, 314, 405, 321, 375,
    78, 191, 80, 81, 82, 13, 312, 311, 310, 415, 308, 95, 88, 178, 87, 14, 317, 402, 318, 324,
)
HAND_LANDMARKS = LEFT_HAND + RIGHT_HAND
LANDMARKS = HAND_LANDMARKS + POSE + len(LIP_LANDMARKS)
STEPS = 32
