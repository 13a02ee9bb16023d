"""The report catalogue: every report is a function from Tables to a lazy DataFrame."""
