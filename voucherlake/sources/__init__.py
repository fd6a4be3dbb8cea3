"""Scans (files, spans, XML, XBRL) and append-only sinks."""
