"""Column-level building blocks; everything here stays inside Catalyst."""
