"""Schemas of the stored documents and tables."""

ENTRY = "struct<seq: bigint, time: string, start: double, end: double, duration: double, text: string>"
TRANSCRIPT = (
    "video_id string, part int, method string, language string, duration_seconds double, entry_count int, error string, "
    f"entries array<{ENTRY}>"
)
KEYFRAME_FIELDS = (
    "timestamp string, timestamp_seconds double, frame_path string, content_type string, "
    "complexity_score double, clip_confidence double"
)
# one schema for bare arrays (flat rows) and wrapped objects (the array column)
KEYFRAMES = f"{KEYFRAME_FIELDS}, keyframes array<struct<{KEYFRAME_FIELDS}>>"
VIDEO_META = (
    "video_id string, title string, duration_seconds int, duration_formatted string, total_keyframes int, "
    "subject string, source_url string, date_processed string, content_type_counts map<string,int>"
)
INTERVENTION = (
    "struct<id: string, video_id: string, timestamp: double, timestamp_formatted: string, frame_path: string, "
    "content_type: string, complexity_score: double, clip_confidence: double, trigger_reason: string, "
    "confidence: string, transcript_context: string, is_bookmarked: boolean, created_at: string>"
)
INTERVENTIONS = f"video_id string, total_interventions int, created_at string, interventions array<{INTERVENTION}>"
ARTIFACT = "video_id string, id string, kind string, value string"
BATCH_REPORT = (
    "index int, url string, video_id string, status string, keyframes int, time_sec double, error string"
)

TABLES = {
    "videos": (
        "id string, title string, duration_seconds int, duration_formatted string, total_keyframes int, "
        "subject string, source_url string, date_processed timestamp, thumbnail_url string"
    ),
    "interventions": (
        "id string, video_id string, timestamp double, timestamp_formatted string, frame_path string, "
        "content_type string, complexity_score double, clip_confidence double, trigger_reason string, "
        "confidence string, transcript_context string, is_bookmarked boolean, created_at timestamp"
    ),
    "explanations": (
        "id int, intervention_id string, text_explanation string, audio_file_path string, text_file_path string, "
        "vlm_snapshot_path string, output_mode string, vlm_snapshot string, created_at timestamp"
    ),
    "transcripts": "id int, video_id string, start_time double, end_time double, text string",
}
# the column that look-ups and joins go by
TABLE_KEYS = {"videos": "id", "interventions": "video_id", "explanations": "intervention_id", "transcripts": "video_id"}
