"""Fixed values of the evaluation and denoising operators."""

from __future__ import annotations

#: Issue: points off a score of 100.
PENALTIES = {
    "missing_id": 10, "missing_text_field": 45, "empty_text": 60, "too_short": 20, "too_long": 15, "abnormal_chars": 25, "duplicate_text": 25, "high_repetition": 20,
    "consecutive_punctuation_abnormal": 10, "special_characters_abnormal": 20, "punctuation_pairing_abnormal": 15, "missing_label": 20,
    "missing_image_path": 60, "image_not_found": 70, "image_unreadable": 70, "image_broken": 70, "unsupported_format": 20, "width_too_small": 20, "height_too_small": 20,
    "aspect_ratio_abnormal": 15, "blurred_image": 25, "pure_white_image": 45, "pure_black_image": 45, "near_solid_color_image": 30, "blank_content_image": 40,
    "suspected_aigc_image": 30, "duplicate_image": 25, "image_text_inconsistent": 30,
    "missing_audio_path": 60, "audio_not_found": 70, "audio_decode_failed": 70, "unsupported_audio_format": 20, "audio_sample_rate_mismatch": 20, "audio_bit_depth_mismatch": 20,
    "audio_volume_range_abnormal": 25, "audio_clipping_detected": 25, "audio_noise_detected": 20, "audio_echo_detected": 20, "audio_cleanliness_abnormal": 25, "duplicate_audio": 25,
    "bbox_out_of_bounds": 20, "operator_error": 30,
}
#: Issues after which a row is dropped whatever its score.
FATAL = (
    "missing_text_field", "empty_text", "missing_image_path", "image_not_found", "image_unreadable", "image_broken", "pure_white_image", "pure_black_image",
    "blank_content_image", "suspected_aigc_image", "missing_audio_path", "audio_not_found", "audio_decode_failed",
)
#: What to do about an issue, in our words.
SUGGESTIONS = {
    "missing_id": "Give the row a stable id.", "missing_text_field": "Add the text field or drop the row.", "empty_text": "Fill the text or drop the row.", "too_short": "Add context or drop the row.",
    "too_long": "Split, cut or review the text.", "abnormal_chars": "Clean garbled text and odd signs.", "duplicate_text": "Keep one row of each text.", "high_repetition": "Clean repeated fragments.",
    "consecutive_punctuation_abnormal": "Mend runs of punctuation.", "special_characters_abnormal": "Take out hidden and control characters.", "punctuation_pairing_abnormal": "Close brackets and quotes.",
    "missing_label": "Label the row.", "image_not_found": "Restore the image file.", "image_unreadable": "Replace the image file.", "blurred_image": "Take a sharper image.", "duplicate_image": "Keep one of equal images.",
    "audio_not_found": "Restore the audio file.", "audio_decode_failed": "Replace the audio file.", "duplicate_audio": "Keep one of equal recordings.", "bbox_out_of_bounds": "Mend the box.",
}
#: Share off a text's quality of 1 for each issue, and for an issue that is not listed.
TEXT_PENALTIES = {
    "empty_text": 1.0, "too_short": 0.35, "too_long": 0.15, "high_repetition": 0.45, "low_info_density": 0.35, "sensitive_risk": 0.65, "operator_failed": 0.45, "invalid_json": 0.7,
    "encoding_low_confidence": 0.15, "possible_mojibake": 0.25, "language_unknown": 0.15, "language_mismatch": 0.45, "semantic_low_quality": 0.45, "semantic_needs_review": 0.2,
    "semantic_repairable": 0.0, "text_repaired": 0.0, "llm_api_fallback": 0.0,
}
TEXT_PENALTY_OTHER = 0.03
#: Share off the score of an image-text pair.
PAIR_PENALTIES = {
    "image_text_mismatch": 0.18, "ocr_text_mismatch": 0.12, "ocr_key_field_conflict": 0.5, "clip_mismatch": 0.5, "vlm_inconsistent": 0.25, "vlm_contradiction": 0.8, "pair_safety_risk": 1.0,
    "sensitive_risk": 0.65, "safety_risk": 0.9, "qrcode_detected": 0.85, "watermark_detected": 0.2, "logo_detected": 0.2, "pair_missing_image": 1.0, "pair_missing_text": 1.0, "image_missing": 1.0, "decode_failed": 1.0,
}
#: Parts of the score of an image-text pair: metric, value if it is missing (another metric or a number), weight.
PAIR_PARTS = (
    ("text_quality_score", 1.0, 0.16), ("image_quality_score", 1.0, 0.16), ("image_text_similarity_score", 0.5, 0.14), ("clip_similarity_score", "image_text_similarity_score", 0.18), ("ocr_consistency_score", 0.5, 0.08),
    ("ocr_key_field_consistency_score", 0.5, 0.1), ("vlm_consistency_score", "clip_similarity_score", 0.1), ("pair_safety_score", 1.0, 0.06),
)
#: Issues after which the denoising gate drops a row.
HARD_FAIL = (
    "data_leakage_suspected", "unknown_modality", "empty_text", "image_missing", "decode_failed", "invalid_json", "unsupported_language", "language_mismatch", "too_short", "text_too_short", "repetition_high",
    "low_info_density", "text_sensitive_masked", "sensitive_content", "semantic_low_quality", "low_resolution", "pure_color", "qrcode_detected", "watermark_detected", "logo_detected", "image_safety_risk",
    "safety_risk", "pair_missing_image", "pair_missing_text", "clip_mismatch", "vlm_contradiction", "ocr_key_field_conflict", "pair_safety_risk", "video_missing", "no_video_stream", "ffprobe_failed",
    "black_frames", "freeze_frames", "video_qrcode_detected", "video_safety_risk", "sensitive_speech_text", "audio_visual_inconsistent", "speech_subtitle_inconsistent", "video_too_short", "low_video_resolution",
)
#: Words of risky content by category.
RISKY = {
    "violence": ("暴恐", "恐怖袭击", "极端组织"), "porn": ("涉黄", "色情", "裸聊"), "gambling": ("赌博", "博彩", "六合彩"), "fraud": ("诈骗", "刷单返利", "套现", "杀猪盘"), "abuse": ("辱骂", "人身攻击"), "spam": ("加微信", "推广返佣", "点击领取"),
}
#: Names of fields that give an answer away.
LEAKING = (
    "expected", "expected_action", "expected_clean", "expected_file", "expected_keywords", "ground_truth", "gold", "label_for_eval", "manifest", "oracle", "reference_image_path", "reference_path", "source_reference", "target_action",
)
#: Signs of text that was decoded with the wrong table.
GARBLED = ("�", "Ã", "Â", "â", "è", "æ", "å", "¤", "½", "¼")
