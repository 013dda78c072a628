"""Sources and sinks: transcripts, workbooks, the response cache, staged tables."""
