"""streaming of driftsum."""
