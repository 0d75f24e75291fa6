"""sources of driftsum."""
