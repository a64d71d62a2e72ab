"""Part of the package; see the README."""
