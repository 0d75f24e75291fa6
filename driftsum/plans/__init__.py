"""plans of driftsum."""
