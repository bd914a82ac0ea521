"""Part of corpusloom: operators."""
