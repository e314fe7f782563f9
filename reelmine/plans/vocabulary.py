"""Fixed values of the model: statuses, card types and the transition relation."""

STATUSES = ("discovered", "metadata_ok", "transcript_ok", "no_transcript", "lang_missing", "unavailable", "age_restricted", "skipped", "retry", "failed")
CARD_TYPES = ("rule", "procedure", "rationale", "definition", "example", "number", "psychology", "caveat", "opinion", "anecdote", "contradiction")
REPROCESSED = ("discovered", "metadata_ok", "retry")

#: From each status the statuses that may follow it.
TRANSITIONS = {
    "discovered": ("discovered", "metadata_ok", "skipped", "unavailable", "retry", "failed", "transcript_ok", "no_transcript", "lang_missing", "age_restricted"),
    "metadata_ok": ("metadata_ok", "transcript_ok", "no_transcript", "lang_missing", "unavailable", "age_restricted", "skipped", "retry", "failed"),
    "retry": ("retry", "metadata_ok", "transcript_ok", "no_transcript", "lang_missing", "unavailable", "age_restricted", "skipped", "failed"),
    "no_transcript": ("no_transcript", "metadata_ok", "transcript_ok", "lang_missing", "unavailable", "age_restricted", "retry", "failed"),
    "lang_missing": ("lang_missing", "metadata_ok", "transcript_ok", "no_transcript", "unavailable", "age_restricted", "retry", "failed"),
    "skipped": ("skipped", "metadata_ok", "discovered", "unavailable"),
    "failed": ("failed", "metadata_ok", "retry", "transcript_ok", "no_transcript", "lang_missing", "unavailable", "age_restricted"),
    "age_restricted": ("age_restricted", "metadata_ok", "transcript_ok", "no_transcript", "lang_missing", "unavailable", "retry", "failed"),
    "unavailable": ("unavailable", "metadata_ok"),
    "transcript_ok": ("transcript_ok", "metadata_ok"),
}
