"""functions of driftsum."""
