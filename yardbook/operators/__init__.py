"""Finance operators: functions from a table catalog to a lazy DataFrame."""
