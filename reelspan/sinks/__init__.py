"""Sinks: subtitles, saved transcripts, edit decision lists, text files."""
