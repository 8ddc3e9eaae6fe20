"""Part of plumbline; see the README for the map of modules."""
