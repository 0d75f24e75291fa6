"""operators of driftsum."""
