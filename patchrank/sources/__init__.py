"""Readers, writers and provenance-aware artefact access."""
