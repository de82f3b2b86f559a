"""Small synthetic inputs."""

POINT_SCHEMA = "sequence_id string, frame int, landmark int, x double, y double, z double"


def clips():
    """Three eight-frame sequences: two moving hands, one without hands."""
    rows = []
    for i in range(8):
        rows += [("hello", i, 0, 0.2 + 0.1 * i, 0.3, 0.0), ("please", i, 0, 0.4, 0.2 + 0.1 * i, 0.0),
                 ("no-hands", i, 80, 0.5, 0.5, 0.0)]
    return rows


def manifest_rows():
    """(row_number, 13 manifest columns)."""
    def row(n, kind, word, performed, signer, label, status, points, anomaly=""):
        return (n, f"synthetic:{kind}:{word.lower()}", word, performed, signer, "clips", "test", kind,
                label, status, f"v/{n}.mp4", points, anomaly, f"{kind}-{n}")
    return [
        row(2, "positive", "HELLO", "HELLO", "s1", "true", "target_variant", "hello"),
        row(3, "positive", "PLEASE", "PLEASE", "s2", "true", "target_variant", "please"),
        row(4, "hard_negative", "HELLO", "PLEASE", "s3", "false", "different_sign", "please"),
        row(5, "random_negative", "PLEASE", "HELLO", "s4", "false", "different_sign", "hello"),
        row(6, "invalid", "THANKYOU", "", "s5", "false", "different_sign", "no-hands", "hands_not_visible"),
        row(7, "hard_negative", "THANKYOU", "", "s6", "", "unreviewed", ""),
    ]


def calibration_rows():
    """Text rows: per split two positives, two negatives, one gated, plus a repeat and an unreviewed row."""
    from motionmatch.schemas import CALIBRATION_COLUMNS
    sims = [("positive", "true", .96, .65), ("positive", "true", .90, .70),
            ("hard_negative", "false", .65, .92), ("random_negative", "false", .40, .85)]
    rows, n = [], 2

    def add(sample, split, kind, label, status, repeat, valid, features, score="80", accepted="true"):
        nonlocal n
        values = dict(
            sample_id=sample, target_word="HELLO", performed_word="HELLO" if kind != "invalid" else "",
            signer_id=f"signer-{split}", source="synthetic", split=split, sample_type=kind, expected_pass=label,
            variant_status=status, source_sample_id=sample, anomaly_type="", repeat_index=str(repeat),
            quality_valid=valid, score=score, accepted=accepted, **features)
        rows.append((n, *[values[c] for c in CALIBRATION_COLUMNS]))
        n += 1

    def features(t, o):
        return dict(target_similarity=str(t), best_other_similarity=str(o), similarity_margin=str(round(t - o, 2)),
                    hand_visibility="0.9", motion_energy="0.04", motion_span="0.3", sequence_completeness="1",
                    start_position_difference="0.2", end_position_difference="0.2")

    for split in ("train", "val", "test"):
        for i, (kind, label, t, o) in enumerate(sims):
            add(f"{split}-{kind}-{i}", split, kind, label,
                "target_variant" if label == "true" else "different_sign", 0, "true", features(t, o))
        gated = features(0, 0) | dict(target_similarity="", best_other_similarity="", similarity_margin="")
        add(f"{split}-invalid", split, "invalid", "false", "different_sign", 0, "false", gated, "0", "false")
    add("train-positive-0", "train", "positive", "true", "target_variant", 1, "true", features(.96, .65))
    add("val-new", "val", "hard_negative", "", "unreviewed", 0, "true", features(.5, .5))
    return rows
