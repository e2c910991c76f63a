"""Sources: media files, transcripts, vocabularies, logs, settings, and the transcript tables derived from the driver's data."""
