"""Parameter spaces, phases and provenance."""
