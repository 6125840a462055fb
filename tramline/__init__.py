"""Part of the tramline engine."""
