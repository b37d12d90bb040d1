"""Failure classes and their subclasses, intervention sources and judges that records may name."""

# Records carry these words, so they must be the same wherever records are exchanged.
SUBCLASSES = {
    "perception": ["target_not_detected", "wrong_object", "pose_or_depth_error", "occlusion", "lighting_or_reflection", "camera_moved_or_drift"],
    "grasp": ["missed_grasp", "slip", "unstable_grasp", "wrong_grasp_point", "gripper_convention"],
    "planning": ["wrong_decomposition", "invalid_ordering", "missing_prerequisite", "unsafe_plan", "wrong_recovery"],
    "action": ["oscillation", "freeze", "direction_reversal", "inconsistent_chunks", "excessive_magnitude", "wrong_gripper_command"],
    "control": ["tracking_error", "delay_or_jitter", "unexpected_contact", "collision", "jam", "excessive_force", "inadequate_compliance"],
    "hardware": ["dropped_frames", "stale_telemetry", "sensor_drift", "encoder_disagreement", "motor_overheating", "gripper_wear", "network_loss", "battery"],
    "environment": ["object_out_of_reach", "novel_object", "clutter", "human_interference", "fixture_misaligned", "consumable_missing"],
    "language": ["ignored_instruction", "ambiguous_instruction", "negation_failed", "wrong_target_from_language"],
    "timeout": ["no_progress", "slow_but_progressing", "stuck_in_retry"],
    "safety_stop": ["operator_stop", "monitor_stop", "e_stop", "workspace_limit"],
    "human_error": ["bad_reset", "wrong_task_setup", "label_error"],
    "unknown": ["unknown"],
}
CLASSES = list(SUBCLASSES)
MANUAL_SOURCES = ["teleop", "reset", "stop"]
GUARD_LEVELS = ["ok", "slow", "handover", "stop"]
