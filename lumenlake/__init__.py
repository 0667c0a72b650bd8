"""lumenlake."""
