"""Schemas of the records that the engine reads and writes."""




PAIR_DDL = "instruction STRING, input STRING, output STRING"
REPORT_DDL = (
    "input STRING, reference STRING, normalized STRING, normalized_wer DOUBLE, transcribed STRING, wer DOUBLE, error STRING"
)
RUN_DDL = (
    "engine STRING, git_commit STRING, checkpoint STRING, eval_rows BIGINT, note STRING, "
    "normalizer_wer DOUBLE, round_trip_wer DOUBLE"
)
AUDIO_DDL = "text STRING, mime STRING, name STRING, bytes BINARY"
REQUEST_DDL = "text STRING, engine STRING"
SENTENCES_DDL = "sentences ARRAY<STRING>"
NORMALIZED_DDL = "normalized_text STRING"
