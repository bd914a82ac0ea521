"""Part of corpusloom: functions."""
